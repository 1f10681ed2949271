"""Variant spellings of names typed by people (problem 3).

A name is read as a noisy channel's output: someone meant a canonical stop (town, street or landmark,
direction) and typed it in some order, abbreviated and with typos. Frequent spellings are the candidate
canonical forms. Each other spelling is attached to the candidate of the largest posterior, or stays
canonical where that explains it better: the expected number of times that the candidate, given its
frequency and the likelihoods of edits and abbreviations, is typed so, against a new name of so many
letters. The likelihoods are estimated from the links they give, and estimated again.

What the words of a name mean is learned from the names too: words and endings that follow many stems,
joined or apart, are street words, and those that share their stems are their short forms; words that go
with many streets are directions, or say nothing; words that go with many others in names of two are
towns. Towns are settled first, streets within their town. All candidate search is by equi-joins on
hashed keys over distinct spellings; no group of spellings or entries is ever held by one task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.llm.lookalike import normal_texts
from footmesh.llm.pairs import paired
from footmesh.runtime import cut

# Texts that a form offers, or a register writes, where a stop has no name.
PLACEHOLDERS = ("neuer halt", "neue haltestelle", "mein stopp", "test", "haltestelle ohne namen", "haltestelle", "halt", "ohne namen", "unbenannt", "unbekannt", "unbekannte haltestelle")

# Edits that are searched for, and the letters of a spelling that the search keys are made of.
EDITS, KEY_PREFIX = 2, 9
# Shares of spellings with no, one and two edits, and of abbreviated ones, before any is estimated.
FIRST_SHARES, FIRST_SHORT = (0.9, 0.08, 0.02), 0.05
# Letters of the longest street word that is learned.
LONGEST_TAIL = 24
# A learned word occurs in so many names at least, and in so large a share of them; the share bounds their number.
LEAST, LEAST_SHARE = 3, 0.0002
# Different edits that a letter may take, where none are seen, and the fewest.
EDIT_KINDS, FEWEST_KINDS = 52.0, 2.0
# A spelling so much rarer than its neighbour shows how edits spread over their kinds.
MUCH_RARER = 20.0
# What stands for the number of times that a further reading of a spelling is typed.
READING = -1.0


WRITTEN_OUT = ("ae", "oe", "ue")


def plain(text: str) -> str:
    """Without case and accents; one blank between words."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).split())


def fold(text: str) -> str:
    """Without case, accents and the ways to write them out; one blank between words."""
    text = plain(text)
    for two in WRITTEN_OUT:
        text = text.replace(two, two[0])
    return text


def readings(text: str) -> list[str]:
    """A plain text folded but for one pair of letters, once a pair: ae, oe or ue may be no umlaut but what a typo left."""
    at = [k for k in range(len(text) - 1) if text[k : k + 2] in WRITTEN_OUT]
    return sorted({fold(text[:k]) + text[k : k + 2] + fold(text[k + 2 :]) for k in at} - {fold(text)})


_placeholders = {fold(t) for t in PLACEHOLDERS}


def tokens_of(text: str) -> tuple[list[str], list[bool], list[str]]:
    """Folded words, each with the full stop that may follow it, whether each is in small letters where others are not, and the plain words."""
    if fold(text).strip(" .!?") in _placeholders or not re.search(r"[^\W\d_]", text):
        return [], [], []
    raw = re.findall(r"[^\W_]+\.?", unicodedata.normalize("NFKC", text))
    mixed = any(c.isupper() for c in text)
    return [fold(w) for w in raw], [mixed and w[0].islower() for w in raw], [plain(w) for w in raw]


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein (neighbouring letters may change places), or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def deletions(text: str, most: int = EDITS) -> set[str]:
    """The text's first letters with up to ``most`` of them left out: two texts within ``most`` edits share one."""
    head = text[:KEY_PREFIX]
    out = {head}
    for n in range(1, most + 1):
        for gone in combinations(range(len(head)), n):
            out.add("".join(c for k, c in enumerate(head) if k not in gone))
    # an edit before the cut moves one letter across it
    return out | {x[: KEY_PREFIX - most] for x in out}


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys = [sorted(deletions(t)) for t in frame["text"]]
        out = frame.loc[frame.index.repeat([len(k) for k in keys])]
        yield out.assign(k=[x for ks in keys for x in ks])


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Over as many partitions as the session shuffles to: what follows costs far more than its bytes tell, so few bytes must not end in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def keyed(forms: DataFrame) -> DataFrame:
    """``forms``: grp, text, n. A row a deletion key, hashed with the group."""
    rows = spread(forms, "grp", "text").mapInPandas(_keys, "grp string, text string, n double, k string")
    return rows.select("grp", "text", "n", F.xxhash64("grp", "k").alias("k"))


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        d = np.array([distance(a, b, EDITS) for a, b in zip(frame["text"], frame["canon"])], np.int32)
        yield frame.assign(d=d)[d <= EDITS]


def near_forms(variants: DataFrame, candidates: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Pairs grp, text, n, canon, m, d of different spellings of a group within EDITS edits.

    ``wide``: grp, text, wide are further readings of variants; the nearest one counts.
    """
    if wide is not None:
        read = cut(variants.join(wide, ["grp", "text"]).select("grp", "text", "n", "wide"))
        others = read.select("grp", F.col("wide").alias("text"), F.lit(READING).alias("n")).distinct()
        # one search for both
        near = cut(near_forms(variants.select("grp", "text", "n").unionByName(others), candidates))
        further = near.where(F.col("n") == READING).drop("n").withColumnRenamed("text", "wide").join(read, ["grp", "wide"]).where("text <> canon")
        both = near.where(F.col("n") != READING).unionByName(further.select("grp", "text", "n", "canon", "m", "d"))
        return both.groupBy("grp", "text", "n", "canon", "m").agg(F.min("d").alias("d"))
    v, c = keyed(variants), keyed(candidates).select("k", F.col("grp").alias("g"), F.col("text").alias("canon"), F.col("n").alias("m"))
    alike = F.abs(F.length("text") - F.length("canon")) <= EDITS
    pairs = v.join(c, "k").where((F.col("grp") == F.col("g")) & (F.col("text") != F.col("canon")) & alike).select("grp", "text", "n", "canon", "m").distinct()
    return spread(pairs, "grp", "text").mapInPandas(_measure, "grp string, text string, n double, canon string, m double, d int")


@dataclass(frozen=True)
class Channel:
    """How names are typed: shares of spellings by number of edits, kinds of an edit at a letter, the share that is shortened, and nats a letter of a new name carries."""

    shares: tuple[float, ...] = FIRST_SHARES
    short: float = FIRST_SHORT
    letter: float = 2.0
    kinds: float = EDIT_KINDS

    def edit_log(self, d: Column, text: Column) -> Column:
        """Log-probability that a name comes out as one certain spelling with ``d`` edits."""
        share = F.element_at(F.array(*(F.lit(math.log(max(s, 1e-6))) for s in self.shares)), d + 1)
        return share - d * F.log(F.lit(self.kinds) * F.greatest(F.length(text), F.lit(1)))

    def explained(self, n: Column, m: Column, log_p: Column) -> Column:
        """Log-likelihood of ``n`` such spellings of a name that was typed ``m`` times: a geometric count, as the rate of one certain typo varies."""
        rate = m * F.exp(log_p)
        return n * F.log(rate / (1 + rate)) - F.log1p(rate)

    def identity(self, n: Column, text: Column) -> Column:
        """Log-likelihood of a name of its own that is typed so ``n`` times."""
        return n * F.log(n / (1 + n)) - F.log1p(n) - F.length(text) * self.letter


def estimated(near: DataFrame, forms: DataFrame, first: Channel, rounds: int = 2) -> Channel:
    """The channel by rounds of expectation maximisation over links: the shares of spellings by edits, smoothed by the first ones.

    How many kinds of edit there are is told by how often two typos of a name are the same one.
    """
    rare = near.where((F.col("d") == 1) & (F.col("n") * MUCH_RARER <= F.col("m"))).groupBy("grp", "canon")
    rare = rare.agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    seen = rare.where("all > 1").agg(F.sum("same").alias("same"), F.sum(F.col("all") * (F.col("all") - 1)).alias("pairs"), F.sum(F.col("all") * (F.col("all") - 1) * F.length("canon")).alias("letters")).first()
    kinds = EDIT_KINDS
    if seen.pairs:
        length = seen.letters / seen.pairs
        # ten pairs without a repeat are taken as seen
        kinds = min(EDIT_KINDS, max(FEWEST_KINDS, (seen.pairs + 10) / (seen.same + 10 / (EDIT_KINDS * length)) / length))
    channel = Channel(first.shares, first.short, first.letter, kinds)
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        got = {int(r.d): float(r.n) for r in best_links(near, channel).groupBy("d").agg(F.sum("n").alias("n")).collect()}
        counts = [max(0.0, total - sum(got.values()))] + [got.get(d, 0.0) for d in range(1, EDITS + 1)]
        # the first shares count as a hundred names
        channel = Channel(tuple((c + 100 * f) / (sum(counts) + 100) for c, f in zip(counts, FIRST_SHARES)), first.short, first.letter, kinds)
    return channel


def letter_nats(forms: DataFrame) -> float:
    """Entropy of the letters of spellings: what a letter of a new name carries."""
    letters = forms.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    total = letters.agg(F.sum("n").alias("t"))
    row = letters.join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).first()[0]
    # letters of a name depend on one another; a text's own entropy is about two thirds of that of single letters
    return max(1.0, (row or 0.0) * 2 / 3)


def best_links(near: DataFrame, channel: Channel) -> DataFrame:
    """grp, text, up, d, n: of each spelling that is better explained as another the candidate of the largest posterior."""
    worse = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("canon") < F.col("text")))
    score = channel.explained(F.col("n"), F.col("m"), channel.edit_log(F.col("d"), F.col("text")))
    better = near.where(worse).withColumn("score", score).where(F.col("score") > channel.identity(F.col("n"), F.col("text")))
    return better.groupBy("grp", "text").agg(F.max_by(F.struct("canon", "d", "n"), F.struct("score", "m", "canon")).alias("b")).select("grp", "text", F.col("b.canon").alias("up"), "b.d", "b.n")


def attach(forms: DataFrame, channel: Channel | None = None, wide: DataFrame | None = None) -> tuple[DataFrame, Channel]:
    """``forms``: grp, text, n, one row each; ``wide`` their further readings. (grp, text, canon, n: every spelling with its canonical form; the channel as estimated.)

    Spellings form a graph of links to more frequent ones; chains are followed to their end.
    """
    forms = cut(forms)
    near = cut(near_forms(forms, forms, wide))
    channel = estimated(near, forms, channel or Channel(letter=letter_nats(forms)))
    best = best_links(near, channel).select("grp", "text", "up")
    links = cut(forms.join(best, ["grp", "text"], "left").select("grp", "text", "n", F.coalesce("up", "text").alias("canon")))
    while True:
        # pointers lead to ever more frequent spellings, so jumping doubles the distance each round and ends
        over = links.select("grp", F.col("text").alias("canon"), F.col("canon").alias("next"))
        jumped = cut(links.join(over, ["grp", "canon"]).select("grp", "text", "n", F.col("next").alias("canon"), (F.col("next") != F.col("canon")).alias("moved")))
        links = jumped.select("grp", "text", "n", "canon")
        if jumped.where("moved").isEmpty():
            return links, channel


def prefixes(candidates: DataFrame, heads: DataFrame, slack: int = 0) -> DataFrame:
    """grp, p, canon, m: the beginnings of candidates (grp, text, n) that are as long as some head (grp, text) of their group, give or take ``slack`` letters."""
    sizes = heads.select("grp", F.explode(F.sequence(F.length("text") - slack, F.length("text") + slack)).alias("l")).where("l > 0").distinct()
    rows = candidates.select("grp", F.col("text").alias("canon"), F.col("n").alias("m")).join(sizes, "grp").where("l <= length(canon)")
    return rows.select("grp", F.expr("left(canon, l)").alias("p"), "canon", "m")


def unfold(short: DataFrame, candidates: DataFrame, channel: Channel) -> DataFrame:
    """``short``: grp, text with full stops where letters are left out; ``candidates``: grp, text, n. grp, text, canon: the likeliest candidate of each.

    The letters before the first stop begin the name, the others follow in order. Where nothing fits, the
    beginning may have a typo.
    """
    short = cut(short.select("grp", "text").where("text <> ''").distinct().select("grp", "text", F.substring_index("text", ".", 1).alias("p"), F.replace("text", F.lit("."), F.lit("%")).alias("shape")))
    heads = short.where("p <> ''").select("grp", F.col("p").alias("text")).distinct()
    exact = short.join(prefixes(candidates, heads), ["grp", "p"]).where(F.expr("canon like shape"))
    exact = cut(exact.groupBy("grp", "text").agg(F.max_by("canon", F.struct("m", "canon")).alias("canon")))
    missed = cut(short.where("length(p) > 2").join(exact.select("grp", "text"), ["grp", "text"], "left_anti"))
    heads = cut(missed.select("grp", F.col("p").alias("text"), F.lit(1.0).alias("n")).distinct())
    at = cut(prefixes(candidates, heads, 1))
    near = near_forms(heads, at.groupBy("grp", F.col("p").alias("text")).agg(F.max("m").alias("n")))
    found = missed.join(near.select("grp", F.col("text").alias("p"), F.col("canon").alias("q"), "d"), ["grp", "p"]).join(at.select("grp", F.col("p").alias("q"), "canon", "m"), ["grp", "q"])
    # what follows the first stop still has to fit
    found = found.where(F.expr("canon like concat(q, substr(shape, length(p) + 1))"))
    score = F.log("m") + channel.edit_log(F.col("d"), F.col("p"))
    likely = found.where(score > -F.length("p") * channel.letter)
    blurred = likely.groupBy("grp", "text").agg(F.max_by("canon", F.struct(score, "m", "canon")).alias("canon"))
    return exact.unionByName(blurred)


@dataclass
class Lexicon:
    """What words mean by themselves: endings of streets with their full form, and words beside a street with the direction they stand for ("" for none)."""

    tails: dict[str, str] = field(default_factory=dict)
    extras: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.by_length = sorted(self.tails, key=lambda t: (-len(t), t))
        self.directions = sorted({v for v in self.extras.values() if v})

    def full_tails(self) -> list[str]:
        return sorted(set(self.tails.values()))


def landmarks_of(aliases: pd.DataFrame) -> dict[str, str]:
    """Folded short and formal names without blanks to the folded formal one."""
    out: dict[str, str] = {}
    squeeze = lambda t: re.sub(r"[\W_]+", "", fold(t))
    for short, formal in aliases.itertuples(index=False):
        if isinstance(formal, str) and squeeze(formal):
            out[squeeze(formal)] = squeeze(formal)
            if isinstance(short, str) and squeeze(short):
                out.setdefault(squeeze(short), squeeze(formal))
    return out


def names_of(names: DataFrame) -> DataFrame:
    """name, n, reg -> name, n, reg, words, small, plain: distinct names that may mean a stop, folded and cut into words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [tokens_of(t) for t in normal_texts(frame["name"].tolist())]
            yield frame.assign(words=[w for w, _, _ in got], small=[s for _, s, _ in got], plain=[p for _, _, p in got])[[bool(w) for w, _, _ in got]]

    return names.mapInPandas(run, "name string, n double, reg boolean, words array<string>, small array<boolean>, plain array<string>")


def word_readings(words: DataFrame) -> DataFrame:
    """grp "", text, wide: further readings of the words that hold ae, oe or ue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [(w, r) for w, p in zip(frame["text"], frame["plain"]) for r in readings(p)]
            yield pd.DataFrame({"grp": "", "text": [w for w, _ in got], "wide": [r for _, r in got]}, dtype=object)

    each = words.select(F.explode(F.arrays_zip("words", "plain")).alias("x")).select(_bare("x.words").alias("text"), _bare("x.plain").alias("plain"))
    return each.where("text <> plain").distinct().mapInPandas(run, "grp string, text string, wide string").distinct()


def _bare(c: str | Column) -> Column:
    return F.rtrim(F.col(c) if isinstance(c, str) else c, F.lit("."))


def least_names(count: int) -> int:
    return max(LEAST, math.ceil(LEAST_SHARE * count))


def _shortened(form: str, full: str) -> bool:
    """The letters of ``form`` occur in ``full`` in order, from the same beginning, or it is within two edits."""
    rest = iter(full)
    return (form[:1] == full[:1] and all(c in rest for c in form)) or distance(form, full, 2) <= min(2, len(full) // 3)


def learn_tails(words: DataFrame, least: int) -> dict[str, str]:
    """Street words and their short forms, each with its full form.

    A street word follows many stems both as a word of its own and joined on. What else follows the same
    stems, and is made of its letters, is a short or misspelt form of it. Only words and endings that
    follow ``least`` stems come to the driver, of which there are at most 1 / LEAST_SHARE to a stem.
    """
    pair = F.explode(F.arrays_zip(F.expr("slice(words, 1, size(words) - 1)").alias("a"), F.expr("slice(words, 2, size(words) - 1)").alias("b"))).alias("p")
    beside = cut(words.where("size(words) > 1").select(pair).where("p.a not like '%.'").select(F.col("p.a").alias("s"), _bare("p.b").alias("e")).where("e <> ''").distinct())
    vocabulary = cut(words.select(F.explode("words").alias("w")).select(_bare("w").alias("w")).where("w <> ''").distinct())
    joined = beside.join(vocabulary, F.concat("s", "e") == F.col("w"), "left_semi")
    alone = beside.groupBy("e").agg(F.count("*").alias("left")).join(joined.groupBy("e").agg(F.count("*").alias("both")), "e").where((F.col("both") >= least) & (F.col("both") >= 0.05 * F.col("left")))
    stems = cut(joined.join(alone.select("e"), "e", "left_semi").where("length(s) > 2").select("s").distinct())
    cuts = vocabulary.select("w", F.explode(F.sequence(F.greatest(F.lit(3), F.length("w") - LONGEST_TAIL), F.greatest(F.lit(3), F.length("w") - 1))).alias("l")).where("l < length(w)")
    endings = cuts.select(F.expr("left(w, l)").alias("s"), F.expr("substr(w, l + 1)").alias("e")).join(stems, "s", "left_semi")
    both = cut(endings.unionByName(beside.join(stems, "s", "left_semi")).distinct())
    often = both.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = cut(both.join(often, "e"))
    shared = both.join(both.select("s", F.col("e").alias("f"), F.col("n").alias("m")), "s").where("e <> f and m > n").groupBy("e", "n", "f", "m").agg(F.count("*").alias("k"))
    support = {r.e: r.n for r in often.collect()}
    whole = {r.e for r in alone.select("e").collect()}
    up: dict[str, tuple[float, str]] = {}
    for r in shared.where("k >= 0.2 * n").collect():
        if _shortened(r.e, r.f):
            up[r.e] = max(up.get(r.e, (0.0, "")), (r.k, r.f))
    out = {}
    for e in sorted(support, key=lambda x: (-support[x], x)):
        root, seen = e, {e}
        while root in up and up[root][1] not in seen:
            root = up[root][1]
            seen.add(root)
        if root in whole and len(root) > 2:
            out[e] = root
    return out


def tail_pattern(tails: list[str]) -> str:
    return "^..+(" + "|".join(sorted(map(re.escape, tails), key=lambda t: (-len(t), t))) + ")$" if tails else "^$"


def learn_towns(words: DataFrame, lexicon: Lexicon, marks: DataFrame, wide: DataFrame | None = None) -> tuple[DataFrame, Channel]:
    """(grp "", text, n: towns with the weight of the names that hold them; the channel as their spellings show it).

    In a name of two full words one is the town: a landmark never, a word that ends like a street hardly,
    and else the one that goes with more other words. A town wins against two different words at least.
    """
    two = words.where("size(words) = 2 and words[0] <> words[1] and not exists(words, w -> w like '%.')").select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b")).distinct()
    sides = cut(two.select("a", "b", F.lit(0).alias("at")).unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("at"))))
    partners = sides.groupBy("a").agg(F.count_distinct("b").alias("partners"))
    like_street = F.col("a").rlike(tail_pattern([t for t in lexicon.tails if len(t) > 2])) | F.col("a").isin(*lexicon.tails) if lexicon.tails else F.lit(False)
    rank = cut(partners.join(F.broadcast(marks), partners["a"] == marks["text"], "left").select("a", F.struct(F.col("text").isNull().alias("word"), (~like_street).alias("plain"), "partners").alias("r")))
    met = sides.join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("r").alias("o")), "b")
    won = met.where(F.col("r.word") & ((F.col("r") > F.col("o")) | ((F.col("r") == F.col("o")) & (F.col("at") == 0))))
    winners = won.groupBy("a").agg(F.count_distinct("b").alias("k")).where("k > 1").select(F.col("a").alias("text"))
    weights = words.select("n", F.explode("words").alias("text")).join(winners, "text").groupBy("text").agg(F.sum("n").alias("n"))
    towns = weights.select(F.lit("").alias("grp"), "text", "n")
    links, channel = attach(towns, wide=wide)
    total = links.groupBy("canon").agg(F.sum("n").alias("n"))
    return cut(total.select(F.lit("").alias("grp"), F.col("canon").alias("text"), "n")), channel


def town_odds(hits: DataFrame, names: int) -> float:
    """Log-odds that a name holds a known town, by expectation maximisation over the best score of each name.

    The more towns there are, the less each is worth by its share; what does not change is that a name has one.
    """
    best = hits.groupBy("name").agg(F.max("score").alias("s"))
    rows = best.groupBy(F.round(F.greatest(F.least("s", F.lit(40.0)), F.lit(-40.0))).alias("s")).agg(F.count("*").alias("k")).collect()
    ratio, count = np.exp(np.array([r.s for r in rows], float)), np.array([r.k for r in rows], float)
    share = 0.5
    for _ in range(100):
        share = (float((count * share * ratio / (share * ratio + 1 - share)).sum()) + 1) / (names + 2)
    return math.log(share / (1 - share))


def town_words(words: DataFrame, count: int, towns: DataFrame, channel: Channel, tails: dict[str, str], marks: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """name, at (position of a word), text, town, score: every word of the ``count`` names that may be a town.

    Each word is weighed as a town: its frequency, the likelihood that the town is typed so, the letters
    that speak against chance, and the share of names that hold a town at all. Words that are rather none
    by these give no row.
    """
    each = words.select("name", "n", F.posexplode("words").alias("at", "word")).select("name", "n", "at", _bare("word").alias("text"), F.col("word").endswith(".").alias("dotted")).where("text <> ''")
    forms = cut(each.groupBy(F.lit("").alias("grp"), "text", "dotted").agg(F.sum("n").alias("n")))
    total = towns.agg(F.coalesce(F.sum("n"), F.lit(1.0))).first()[0]
    weight = lambda log_p, text: F.log(F.col("m") / total) + log_p + F.length(text) * channel.letter
    exact = forms.join(towns.select("text", F.col("n").alias("m")), "text").select("text", "dotted", F.col("text").alias("town"), (weight(F.lit(0.0), "text") + 1e3).alias("score"))
    rest = forms.join(towns.select("text"), "text", "left_anti").join(F.broadcast(marks), "text", "left_anti")
    if tails:
        rest = rest.where(~F.col("text").isin(*tails))
    rest = cut(rest)
    near = near_forms(rest.where("not dotted").select("grp", "text", "n"), towns, wide)
    log_p = channel.edit_log(F.col("d"), F.col("text"))
    near = near.where(channel.explained(F.col("n"), F.greatest("m", "n"), log_p) > channel.identity(F.col("n"), F.col("text")))
    near = cut(near.select("text", F.lit(False).alias("dotted"), F.col("canon").alias("town"), weight(log_p, "text").alias("score")))
    cut_log = lambda c: F.log(F.lit(channel.short) / F.length(c))
    dots = rest.where("dotted").select("grp", "text")
    starts = cut(prefixes(towns, dots))
    short = rest.where("dotted").select(F.col("text").alias("p"), "dotted").join(starts, "p").select(F.col("p").alias("text"), "dotted", F.col("canon").alias("town"), weight(cut_log("canon"), "p").alias("score"))
    # one or two letters tell a town only by its frequency
    short = cut(short.where("length(text) > 2 or score > 0"))
    # a shortened town with a typo: near a beginning of its own length
    missed = rest.where("dotted and length(text) > 2").join(short.select("text"), "text", "left_anti").select("grp", "text", "n")
    heads = starts.groupBy("grp", F.col("p").alias("text")).agg(F.max("m").alias("n"))
    blurred = cut(near_forms(missed, heads).select("text", F.col("canon").alias("p"), "d")).join(starts, "p")
    blurred = blurred.select("text", F.lit(True).alias("dotted"), F.col("canon").alias("town"), weight(channel.edit_log(F.col("d"), F.col("text")) + cut_log("canon"), "text").alias("score"))
    scored = exact.unionByName(near).unionByName(short).unionByName(blurred)
    best = scored.groupBy("text", "dotted").agg(F.max_by(F.struct("town", "score"), F.struct("score", "town")).alias("b"))
    hits = cut(each.select("name", "at", "text", "dotted").join(best.select("text", "dotted", "b.*"), ["text", "dotted"]).select("name", "at", "text", "town", "score"))
    return hits.where(F.col("score") > -town_odds(hits, count))


def best_towns(hits: DataFrame, without: dict[str, str] | None = None) -> DataFrame:
    """name, at, town: the likeliest town of each name, by words other than those in ``without``."""
    kept = hits.where(~F.col("text").isin(*without)) if without else hits
    return kept.groupBy("name").agg(F.max_by(F.struct("at", "town"), F.struct("score", -F.col("at"), "town")).alias("b")).select("name", "b.at", "b.town")


def learn_extras(words: DataFrame, towns: DataFrame, tails: dict[str, str], landmarks: dict[str, str], least: int) -> Lexicon:
    """The street words, and words beside a street that go with many streets: the direction each stands for, or "" for those that say nothing.

    ``towns``: name, at. What a register uses is a direction; without a register, what is not always the first
    word. Shorter forms and typos stand for the most frequent direction that they begin or nearly are.
    """
    one = words.join(towns, "name").select("name", "reg", "n", "at", "words").withColumn("rest", F.expr("filter(transform(words, (w, i) -> struct(i as i, w as w)), x -> x.i <> at)"))
    plain = F.filter("rest", lambda x: ~_bare(x["w"]).isin(*tails)) if tails else F.col("rest")
    one = one.withColumn("rest", plain).where("size(rest) > 1")
    pairs = one.select("reg", "n", F.col("rest"), F.explode("rest").alias("x")).select("reg", "n", F.col("x.i").alias("i"), _bare("x.w").alias("w"), F.col("x.w").endswith(".").alias("dotted"), F.explode(F.expr("filter(rest, y -> y.i <> x.i)")).alias("y"))
    pairs = pairs.select("reg", "n", "i", "w", "dotted", _bare("y.w").alias("v")).where("w <> '' and v <> '' and w <> v")
    met = cut(pairs.select("w", "v").distinct())
    many = cut(met.groupBy("w").agg(F.count("*").alias("k")))
    # a word that is also joined on to the words beside it is a street word, however rare
    vocabulary = words.select(F.explode("words").alias("x")).select(_bare("x").alias("x")).distinct()
    street = met.join(vocabulary, F.concat("v", "w") == F.col("x"), "left_semi").groupBy("w").agg(F.count("*").alias("j"))
    many = cut(many.join(street, "w", "left").where("j is null or j < 0.2 * k").select("w", "k"))
    won = met.join(many, "w").join(many.select(F.col("w").alias("v"), F.col("k").alias("o")), "v").where("k > o").groupBy("w").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    won = cut(won)
    stats = pairs.join(won.select("w"), "w", "left_semi").groupBy("w").agg(F.sum("n").alias("n"), F.avg((F.col("i") == 0).cast("double")).alias("first"), F.avg(F.col("dotted").cast("double")).alias("dots"), F.bool_or("reg").alias("reg"), F.bool_or(F.col("reg") & ~F.col("dotted")).alias("listed"))
    rows = {r.w: r for r in stats.join(won, "w").collect() if r.w not in landmarks}
    known = any(r.reg for r in rows.values())
    full = [w for w, r in rows.items() if len(w) > 2 and (r.listed if known else r.first < 0.8 and r.dots < 0.5)]
    # of two spellings of a direction the rarer is a variant
    full = [w for w in full if not any(rows[v].n > rows[w].n and distance(w, v, 1) <= 1 for v in full if v != w)]
    out, more = {}, dict(tails)
    for w in rows:
        near = [v for v in full if v.startswith(w) or (len(w) > 3 and distance(w, v, 1) <= 1)]
        ends = [t for t in sorted(set(tails.values())) if len(w) > 1 and _shortened(w, t)]
        if w in full:
            out[w] = w
        elif near and (known or rows[w].first < 0.8):
            out[w] = max(near, key=lambda v: (rows[v].n, v))
        elif ends and rows[w].dots >= 0.5 and rows[w].first < 0.5:
            more[w] = min(ends, key=lambda t: (distance(w, t, 9), t))
        else:
            out[w] = ""
    return Lexicon(more, out)


def read_name(words: list[str], small: list[bool], at: int | None, lexicon: Lexicon, landmarks: dict[str, str]) -> tuple[str, str, str, str]:
    """(text, other, kind, direction) of a name without its town.

    Text is the street as it reads, its parts joined, with a full stop where letters are left out and its
    ending in full; other is the same without the first word, which may say nothing; kind is @ for a landmark.
    """
    rest = [(w, s) for k, (w, s) in enumerate(zip(words, small)) if k != at]
    direction = set()
    kept = []
    for k, (w, s) in enumerate(rest):
        bare, lone = w.rstrip("."), len(rest) == 1
        if lone or not bare:
            kept.append(w)
        elif bare in lexicon.extras:
            direction.add(lexicon.extras[bare])
        elif s and len(bare) <= 3 and bare not in lexicon.tails and len(rest) > 1 and k < len(rest) - 1 + (at is not None):
            continue
        elif len(bare) > 3 and bare not in lexicon.tails and any(distance(bare, d, 1) <= 1 for d in lexicon.directions):
            direction.add(next(d for d in lexicon.directions if distance(bare, d, 1) <= 1))
        else:
            kept.append(w)
    if not kept:
        # nothing but words that stand beside a street: they are all there is
        kept, direction = [w for w, _ in rest], set()
    way = " ".join(sorted(direction - {""}))

    def whole(parts: list[str]) -> str:
        if not parts:
            return ""
        last, stop = parts[-1].rstrip("."), parts[-1].endswith(".")
        head = "".join(parts[:-1])
        if len(parts) > 1 and last in lexicon.tails:
            return head + lexicon.tails[last]
        tail = next((t for t in lexicon.by_length if last.endswith(t) and len(last) - len(t) > 1 and (len(t) > 2 or stop)), None)
        if tail is not None:
            return head + last[: -len(tail)] + lexicon.tails[tail]
        return head + last + ("." if stop else "")

    text = whole(kept)
    plain = text.replace(".", "")
    bare = "".join(kept).replace(".", "")
    for form in (bare, plain):
        if form in landmarks:
            return landmarks[form], "", "@", way
    if "".join(kept).endswith(".") and len(bare) > 2:
        begun = {landmarks[m] for m in landmarks if m.startswith(bare)}
        if len(begun) == 1:
            return begun.pop(), "", "@", way
    if at is None:
        return "".join(sorted(w.rstrip(".") for w in kept)), "", "", way
    other = whole(kept[1:]) if len(kept) > 1 and kept[1].rstrip(".") not in lexicon.tails else ""
    return text, other, "", way


def resolve_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names``: name, n (weight), reg (whether a register lists it). Gives name, town, place, direction for each distinct name that means a stop.

    A name without a known town is a place of its own, town empty, compared as a whole with its words in
    order of letters. Names that are null, empty, placeholders or hold no letter give no row. The aliases, a
    table of short and formal landmark names of less than a megabyte, come to the driver.
    """
    landmarks = landmarks_of(small_table(aliases))
    spark = names.sparkSession
    marks = spark.createDataFrame([(m,) for m in sorted(landmarks)], "text string")
    words = cut(names_of(names.where("name is not null").groupBy("name").agg(F.sum(F.col("n").cast("double")).alias("n"), F.bool_or("reg").alias("reg"))))
    count = words.count()
    least = least_names(count)
    tails = learn_tails(words, least)
    wide = cut(word_readings(words))
    towns, channel = learn_towns(words, Lexicon(tails), marks, wide)
    hits = town_words(words, count, towns, channel, tails, marks, wide)
    lexicon = learn_extras(words, cut(best_towns(hits)), tails, landmarks, least)
    found = best_towns(hits, lexicon.extras | lexicon.tails)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [read_name(list(ws), list(sm), None if pd.isna(at) else int(at), lexicon, landmarks) for ws, sm, at in zip(frame["words"], frame["small"], frame["at"])]
            text, other, kind, direction = zip(*got) if got else ((), (), (), ())
            wide = [further(list(ws), list(ps), list(sm), None if pd.isna(at) else int(at), t) for ws, ps, sm, at, t in zip(frame["words"], frame["plain"], frame["small"], frame["at"], text)]
            yield pd.DataFrame({"name": frame["name"], "n": frame["n"], "grp": frame["town"].fillna(""), "text": text, "other": other, "kind": kind, "direction": direction, "wide": wide})

    def further(words: list[str], plains: list[str], small: list[bool], at: int | None, text: str) -> list[str]:
        """The street by further readings of a word beside the town."""
        changed = [[*words[:k], r, *words[k + 1 :]] for k, p in enumerate(plains) if k != at and p != words[k] for r in readings(p)]
        got = [read_name(ws, small, at, lexicon, landmarks) for ws in changed]
        return sorted({t for t, _, kind, _ in got if not kind and t} - {text})

    schema = "name string, n double, grp string, text string, other string, kind string, direction string, wide array<string>"
    streets = cut(words.join(found, "name", "left").mapInPandas(read, schema))
    return settle_streets(streets, marks, landmarks, channel)


def small_table(df: DataFrame, most: int = 1_000_000) -> pd.DataFrame:
    """A table that comes to the driver, after a check of its size in characters."""
    size = df.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in df.columns), F.lit(1))), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"a table of {size} characters is too large to be a list of aliases")
    return df.toPandas()


def settle_streets(streets: DataFrame, marks: DataFrame, landmarks: dict[str, str], channel: Channel) -> DataFrame:
    """name, town, place, direction: the readings of ``streets`` with each text led to its canonical one."""
    full = streets.where("kind = '' and text <> '' and text not like '%.%'").groupBy("grp", "text").agg(F.sum("n").alias("n"))
    wide = cut(streets.where("kind = '' and text not like '%.%'").select("grp", "text", F.explode("wide").alias("wide")).distinct())
    attached, channel = attach(full, channel, wide)
    roots = cut(attached.groupBy("grp", F.col("canon").alias("text")).agg(F.sum("n").alias("n")))
    # a rare text may be a landmark's name with a typo
    counts = streets.where("kind = '@'").groupBy("text").agg(F.sum("n").alias("n"))
    formal = streets.sparkSession.createDataFrame(sorted(landmarks.items()), "text string, formal string")
    known = formal.join(counts.withColumnRenamed("text", "formal"), "formal", "left").select(F.lit("").alias("grp"), "text", "formal", F.coalesce("n", F.lit(1.0)).alias("n"))
    rare = roots.groupBy("text").agg(F.max("n").alias("n")).select(F.lit("").alias("grp"), "text", "n")
    near = near_forms(rare, known.select("grp", "text", "n"), wide.select(F.lit("").alias("grp"), "text", "wide").distinct())
    near = near.where(channel.explained(F.col("n"), F.col("m"), channel.edit_log(F.col("d"), F.col("text"))) > channel.identity(F.col("n"), F.col("text")))
    as_mark = cut(near.join(known.select(F.col("text").alias("canon"), "formal"), "canon").groupBy("text").agg(F.max_by("formal", F.struct(-F.col("d"), "m", "formal")).alias("mark")))
    short = streets.where("kind = '' and text like '%.%'")
    unfolded = cut(unfold(short, roots, channel))
    # where the whole reading fits nothing, the one without the first word may
    lone = roots.where("n <= 1").select("grp", "text", F.lit(True).alias("lone"))
    linked = attached.select("grp", "text", "canon").unionByName(unfolded)
    out = cut(streets.join(linked, ["grp", "text"], "left").join(lone, ["grp", "text"], "left"))
    loose = out.where("kind = '' and other <> '' and grp <> '' and (canon is null or lone)").select("grp", F.col("other").alias("text")).distinct()
    again = roots.select("grp", "text", F.col("text").alias("canon")).join(loose, ["grp", "text"], "left_semi").unionByName(unfold(loose.where("text like '%.%'"), roots, channel))
    again = cut(again.select("grp", F.col("text").alias("other"), F.col("canon").alias("second")))
    out = out.join(again, ["grp", "other"], "left").withColumn("canon", F.when(F.col("canon").isNull() | F.col("lone"), F.coalesce("second", "canon")).otherwise(F.col("canon")))
    out = out.withColumn("canon", F.coalesce("canon", F.replace("text", F.lit("."))))
    out = out.join(as_mark.withColumnRenamed("text", "canon"), "canon", "left")
    place = F.when(F.col("kind") == "@", F.concat(F.lit("@"), "text")).when((F.col("grp") != "") & F.col("mark").isNotNull(), F.concat(F.lit("@"), "mark")).otherwise(F.col("canon"))
    return out.select("name", F.col("grp").alias("town"), place.alias("place"), "direction")


def place_key() -> Column:
    return F.concat_ws("|", "town", "place", "direction")


def link_names(entries: DataFrame, key: str, name: str, aliases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, place: every entry whose name means a stop, with that stop's key.

    ``known`` (name) are further names, such as a stop register's, that count towards the frequency of
    spellings and tell directions from words that say nothing. Entries with a null key or name, an empty
    name or a placeholder give no row; repeated rows count once.
    """
    rows = cut(entries.select(F.col(key).alias("id"), F.col(name).alias("name")).where("id is not null and name is not null").distinct())
    counted = rows.groupBy("name").agg(F.count("*").cast("double").alias("n")).withColumn("reg", F.lit(False))
    if known is not None:
        # a register is written with care: one of its rows weighs as much as three typed names
        listed = known.select(F.col(known.columns[0]).alias("name")).groupBy("name").agg((F.count("*") * 3.0).alias("n"))
        counted = counted.unionByName(listed.withColumn("reg", F.lit(True)))
    resolved = cut(resolve_names(counted, aliases))
    return rows.join(resolved, "name").select("id", place_key().alias("place"))


def same_name_pairs(links: DataFrame) -> DataFrame:
    """entry_a, entry_b: every two different entries of a place, the smaller first; hot places are cut into blocks."""
    pairs = paired(links.select("place", "id").distinct(), ["place"], "id")
    return pairs.select(F.col("x").alias("entry_a"), F.col("y").alias("entry_b")).distinct()

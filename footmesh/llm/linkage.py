"""Matching entities across sources without keys (problem 4).

Candidates come from several blockings: by the stop that a name was resolved to, and, for rows whose stop
the other source does not know, by position. Heuristic matching functions vote on each: for a match, against
it, or not at all. A generative label model, fitted by expectation maximisation on the counts of the vote
patterns, learns how often each function is right in either class and which functions err together (those
are modelled jointly), and gives each pattern the posterior probability of a match. The patterns are a fixed
number, so the model sees all candidates and the driver only counts.

What the codes of the other source's modes mean is learned from the candidates too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.functions.geo import haversine_m, present
from footmesh.llm.names import fold, resolve_names, spread
from footmesh.llm.pairs import crossed
from footmesh.runtime import cut

VOTES = ("v_town", "v_place", "v_text", "v_direction", "v_near", "v_mode")
# Metres within which a position speaks for a match, from which it speaks against, and within which rows of unknown stops are compared.
NEAR_M, FAR_M, REACH_M = 250.0, 1_500.0, 250.0
METERS_PER_DEGREE = 111_194.9
# The share of letter pairs in common from which texts are alike.
ALIKE = 0.8
# Functions whose votes are correlated by more than this, given the class, are modelled together.
DEPENDENCE = 0.7
# How often each function is believed to be right before any data, as if so many candidates had shown it: towns, directions, modes and positions agree by chance too.
RIGHT, BELIEF = {"v_town": 0.6, "v_place": 0.98, "v_text": 0.95, "v_direction": 0.6, "v_near": 0.6, "v_mode": 0.6}, 20.0


def mode_code(c: Column) -> Column:
    """A mode's code without case and surrounding blanks; empty is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def prepared(rows: DataFrame, key: str, name: str, lat: str, lon: str, mode: str) -> DataFrame:
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    there = present(la, lo) & ~((la == 0) & (lo == 0))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(name).alias("name"), F.when(there, la).alias("lat"), F.when(there, lo).alias("lon"), mode_code(F.col(mode)).alias("mode")).distinct()


def _pairs_of_letters(text: str) -> set[str]:
    letters = "".join(c for c in fold(text) if c.isalnum())
    return {letters[k : k + 2] for k in range(len(letters) - 1)} or {letters}


def _texts_alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """v_text: by the share of letter pairs in common, of the places where both towns are known, else of the whole names."""
    for frame in frames:
        votes = []
        known = (frame["l_town"] != "") & (frame["r_town"] != "")
        for k, a, b, x, y in zip(known, frame["l_name"], frame["r_name"], frame["l_place"], frame["r_place"]):
            p, q = (_pairs_of_letters(t) for t in ((x, y) if k else (a, b)))
            share = 2 * len(p & q) / (len(p) + len(q))
            votes.append(1 if share >= ALIKE else -1)
        yield frame.assign(v_text=np.array(votes, np.int32))


class LabelModel:
    """Two classes, votes -1, 0, 1; independent given the class but for groups of dependent functions.

    Two functions that err together would convince a model that takes them as independent of whatever
    they say. So each pair is judged by the classes that all other functions suggest.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, right: list[float] | None = None):
        self.right = right or [0.85] * patterns.shape[1]
        self.patterns, self.counts, self.rounds = patterns, counts.astype(float), rounds
        every = list(range(patterns.shape[1]))
        self.groups = self._dependent(every)
        self.posterior = self._fit(self.groups)

    def _codes(self, group: list[int]) -> np.ndarray:
        code = np.zeros(len(self.patterns), int)
        for k in group:
            code = code * 3 + self.patterns[:, k] + 1
        return code

    def _fit(self, groups: list[list[int]]) -> np.ndarray:
        used = [k for g in groups for k in g]
        post = np.clip(0.5 + 0.45 * self.patterns[:, used].mean(1), 0.02, 0.98)
        codes = [self._codes(g) for g in groups]
        for _ in range(self.rounds):
            before = post
            prior = (self.counts @ post + 1) / (self.counts.sum() + 2)
            odds = np.full(len(post), np.log(prior) - np.log1p(-prior))
            for g, code in zip(groups, codes):
                size = 3 ** len(g)
                yes = np.bincount(code, self.counts * post, size) + BELIEF * self._believed(g)
                no = np.bincount(code, self.counts * (1 - post), size) + BELIEF * self._believed(g)[::-1]
                # who abstains, alone or as a whole group, says nothing about the class
                speaks = np.any(self.patterns[:, g] != 0, axis=1)
                spoken = np.unique(code[speaks])
                if len(spoken):
                    odds += np.where(speaks, np.log(yes / yes[spoken].sum())[code] - np.log(no / no[spoken].sum())[code], 0.0)
            post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            if np.abs(post - before).max() < 1e-9:
                break
        return post

    def _believed(self, group: list[int]) -> np.ndarray:
        """Shares of a group's vote codes among matches before any data; read backwards, among the others."""
        shares = np.ones(1)
        for k in group:
            shares = np.outer(shares, [1 - self.right[k], 0.5, self.right[k]]).ravel()
        return shares / shares.sum()

    def _dependent(self, every: list[int]) -> list[list[int]]:
        """Groups of functions whose votes are correlated within the classes of the others."""
        group = {k: k for k in every}
        for a in every:
            for b in every[a + 1 :]:
                rest = [[k] for k in every if k not in (a, b)]
                if len(rest) < 2:
                    continue
                post, tied = self._fit(rest), 0.0
                for w in (self.counts * post, self.counts * (1 - post)):
                    x, y = self.patterns[:, a] - np.average(self.patterns[:, a], weights=w + 1e-12), self.patterns[:, b] - np.average(self.patterns[:, b], weights=w + 1e-12)
                    size = np.sqrt((w @ (x * x)) * (w @ (y * y)))
                    tied += abs(w @ (x * y)) / size * w.sum() / self.counts.sum() if size > 1e-9 else 0.0
                if tied > DEPENDENCE:
                    group = {k: group[a] if g == group[b] else g for k, g in group.items()}
        return [[k for k in every if group[k] == g] for g in dict.fromkeys(group.values())]


def near_rows(left: DataFrame, right: DataFrame, reach_m: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``left`` (l_lat, l_lon) and ``right`` (r_lat, r_lon), all columns of both, at most ``reach_m`` apart and equal in ``keys``, the right side also with its coordinates exchanged.

    Rows of latitude are cut into a whole number of cells of at least that width around the globe, so
    neighbours across the 180th meridian and at any latitude meet; latitudes beyond the poles meet nothing.
    """
    size = reach_m / METERS_PER_DEGREE
    row = lambda lat: F.floor(lat / size).cast("bigint")
    # cells of a row by the latitude of its poleward edge
    cells = lambda r: F.greatest(F.lit(1), F.floor(F.lit(360.0) / size * F.cos(F.radians(F.least(F.lit(90.0), (F.greatest(F.abs(r), F.abs(r + 1)) + 1) * size))))).cast("bigint")
    col = lambda lon, r: F.pmod(F.floor((lon + 180) / 360 * cells(r)).cast("bigint"), cells(r))
    here = left.where("abs(l_lat) <= 90").withColumn("cy", row(F.col("l_lat"))).withColumn("cx", col(F.col("l_lon"), F.col("cy")))
    ways = F.explode(F.array(F.struct(F.col("r_lat").alias("a"), F.col("r_lon").alias("o")), F.struct(F.col("r_lon").alias("a"), F.col("r_lat").alias("o")))).alias("w")
    there = right.where("r_lat is not null and r_lon is not null").select("*", ways).where("abs(w.a) <= 90").withColumn("cy", F.explode(F.sequence(row(F.col("w.a")) - 1, row(F.col("w.a")) + 1)))
    around = F.array_distinct(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.pmod(col(F.col("w.o"), F.col("cy")) + k, cells(F.col("cy")))))
    there = there.withColumn("cx", F.explode(around))
    met = crossed(here, there, [*keys, "cy", "cx"]).where(haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("w.a"), F.col("w.o")) <= reach_m)
    return met.drop("cy", "cx", "w").distinct()


def learn_modes(pairs: DataFrame) -> DataFrame:
    """r_code, means: what each code of the right side's modes stands for, by the left modes of the candidates of one stop.

    A code that holds a mode's name means that; another the mode that it meets most often against what chance
    gives; one that meets none stands for itself.
    """
    met = pairs.where("v_place = 1 and l_mode is not null and r_mode is not null").groupBy("r_mode", "l_mode").agg(F.count("*").cast("double").alias("k"))
    by_left = met.groupBy("l_mode").agg(F.sum("k").alias("kl"))
    lift = met.join(by_left, "l_mode").groupBy("r_mode").agg(F.max_by("l_mode", F.struct(F.contains("r_mode", "l_mode"), F.col("k") / F.col("kl"), "k", "l_mode")).alias("means"))
    return lift.withColumnRenamed("r_mode", "r_code")


def match_sources(left: DataFrame, right: DataFrame, left_cols: tuple[str, ...], right_cols: tuple[str, ...], aliases: DataFrame) -> DataFrame:
    """left_id, right_id, confidence and same (whether nothing of it speaks for another direction or mode) of every candidate.

    ``*_cols`` name key, name, lat, lon and mode. A null mode stands for the only mode that other rows of
    its stop have; where they have several or none the mode does not vote. Rows without a key or whose name
    means no stop match nothing; those whose town is not known are compared all the same. Null, NaN and zero
    positions give no vote; exchanged coordinates are compared both ways. Repeated rows count once.
    """
    a, b = prepared(left, *left_cols), prepared(right, *right_cols)
    names = a.groupBy("name").agg((F.count("*") * 3.0).alias("n")).withColumn("reg", F.lit(True))
    names = names.unionByName(b.groupBy("name").agg(F.count("*").cast("double").alias("n")).withColumn("reg", F.lit(False)))
    places = cut(resolve_names(names, aliases))
    stop = ["town", "place", "direction"]
    side = lambda x, p: cut(x.join(places, "name").select(*(F.col(c).alias(f"{p}_{c}") for c in (*x.columns, *stop)), F.concat_ws("|", *stop).alias(f"{p}_stop")))
    la, rb = side(a, "l"), side(b, "r")
    by_stop = crossed(la.withColumn("stop", F.col("l_stop")), rb.withColumn("stop", F.col("r_stop")), ["stop"]).drop("stop")
    # what the other side does not know by its stop may be spelt beyond recognition, or have no town
    odd_left = la.join(rb.select(F.col("r_stop").alias("l_stop")).distinct(), "l_stop", "left_anti").select(*la.columns)
    known = la.select(F.col("l_stop").alias("r_stop"), F.lit(True).alias("known")).distinct()
    # odd rows of the right meet all of the left, the others the odd ones; rows meet those of the same number
    there = cut(rb.join(known, "r_stop", "left").select(*rb.columns, F.when(F.col("known"), 1).otherwise(0).alias("met")))
    here = la.withColumn("met", F.lit(0)).unionByName(cut(odd_left).withColumn("met", F.lit(1)))
    # a job of its own: the driver plans the rest of a job again after each of its stages
    by_place = cut(near_rows(here, there, REACH_M, ("met",)).select(*la.columns, *rb.columns))
    pairs = by_stop.select(*la.columns, *rb.columns).unionByName(by_place)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    differ = lambda c: vote(F.col(f"l_{c}") == F.col(f"r_{c}"), F.col(f"l_{c}") != F.col(f"r_{c}"))
    apart = F.least(haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")), haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lon"), F.col("r_lat")))
    towns = (F.col("l_town") != "") & (F.col("r_town") != "")
    pairs = pairs.withColumns({
        "v_town": F.when(towns, differ("town")).otherwise(0), "v_place": F.when(F.col("l_stop") == F.col("r_stop"), 1).when(F.col("l_place") == F.col("r_place"), 0).otherwise(-1),
        "v_direction": F.when((F.col("l_direction") == "") & (F.col("r_direction") == ""), 1).otherwise(differ("direction")),
        "v_near": vote(F.coalesce(apart <= NEAR_M, F.lit(False)), F.coalesce(apart > FAR_M, F.lit(False))),
    })
    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", v_text int"
    pairs = cut(spread(pairs, "l_id", "r_id").mapInPandas(_texts_alike, schema))
    codes = cut(learn_modes(pairs))
    means = lambda df: df.join(F.broadcast(codes.withColumnRenamed("r_code", "r_mode")), "r_mode", "left").withColumn("r_mode", F.coalesce("means", "r_mode")).drop("means")
    rb_modes = means(rb)
    modes = la.select(F.col("l_stop").alias("stop"), F.col("l_mode").alias("mode")).unionByName(rb_modes.select(F.col("r_stop").alias("stop"), F.col("r_mode").alias("mode"))).where("mode is not null").groupBy("stop")
    only = cut(modes.agg(F.min("mode").alias("lo"), F.max("mode").alias("hi")).where("lo = hi").select("stop", F.col("lo").alias("only")))
    fill = lambda df, p: df.join(only.withColumnsRenamed({"stop": f"{p}_stop", "only": f"{p}_only"}), f"{p}_stop", "left").withColumn(f"{p}_mode", F.coalesce(f"{p}_mode", f"{p}_only")).drop(f"{p}_only")
    pairs = fill(fill(means(pairs), "l"), "r").withColumn("v_mode", differ("mode"))
    pairs = cut(pairs.select("l_id", "r_id", *VOTES))
    counted = pairs.groupBy(*VOTES).count().orderBy(*VOTES).toPandas()
    spark = left.sparkSession
    schema = ", ".join(f"{v} int" for v in VOTES) + ", confidence double"
    table = []
    if len(counted):
        model = LabelModel(counted[list(VOTES)].to_numpy(int), counted["count"].to_numpy(), right=[RIGHT[v] for v in VOTES])
        table = [(*map(int, p), float(c)) for p, c in zip(model.patterns, model.posterior)]
    # there are at most 3 ** 6 patterns
    out = pairs.join(F.broadcast(spark.createDataFrame(table, schema)), list(VOTES))
    same = (F.col("v_direction") == 1) & (F.col("v_mode") == 1)
    return out.groupBy(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")).agg(F.max("confidence").alias("confidence"), F.bool_or(same).alias("same"))

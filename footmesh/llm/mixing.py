"""Mixing sources to target weights (problem 7).

Every record of a source is wanted the same fractional number of times. Its whole part is given; the
fractional parts are rounded by pivotal dependent rounding: two records transfer mass between them,
weighted by their tokens, in one of the two directions at random, until one is integral. So each
record keeps its expected number of copies and the source its token mass, to within one record.

What stays fractional tends to be the largest record of a chain, so sizes are taken in turn: a source's
large records (fewer than 1 / LARGE of them) are rounded first, by classes of size, the larger first, and
what the rounding of a class's last record adds or takes is spread over all smaller records' fractions.
That keeps every expectation and leaves an error of one small record. The small records, of any number,
are rounded in parallel buckets, whose at most one residual each goes up a reduction tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.runtime import cut, map_groups

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET = 20_000
FAN_IN = 64
EPS = 1e-9
# A record with more than this share of its source's tokens is large.
LARGE = 1e-4


# The pattern by which the public byte-level vocabularies split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, which is read and nothing beside it."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(c: Column) -> Column:
    """A source's name without letter case, blanks, hyphens and underscores; nothing left is null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)[\s_\-‐‑]+", "")), F.lit(""))


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Replace the text by its number of tokens, n_tokens; null texts have none. The rank file goes to the executors with the job."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    file = Path(tokenizer).name
    others = [c for c in docs.columns if c != text]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(SparkFiles.get(file)).encode_ordinary
        for frame in frames:
            yield frame[others].assign(n_tokens=np.array([len(encode(t)) if t else 0 for t in frame[text]], np.int64))

    return docs.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text) + ", n_tokens bigint")


def pivotal(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round fractions ``p`` along the order given, keeping sum(w * p); at most one stays fractional. Weights are positive."""
    p = p.copy()
    held = -1
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        i, j, ratio = held, k, w[held] / w[k]
        up, down = min(1 - p[i], p[j] / ratio), min(p[i], (1 - p[j]) / ratio)
        step = up if u[k] * (up + down) < down else -down
        p[i] += step
        p[j] -= step * ratio
        for x in (i, j):
            if p[x] < EPS or p[x] > 1 - EPS:
                p[x] = round(p[x])
        held = next((x for x in (i, j) if EPS < p[x] < 1 - EPS), -1)
    return p


def cascade(w: np.ndarray, wanted: float, tokens: float, cap: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Copies of the large records of a source: classes of size by powers of two, the larger first.

    ``wanted`` and ``tokens`` are those of the whole source, small records included; each class is rounded
    at the fraction that all records left over then need.
    """
    copies = np.zeros(len(w))
    kind = np.floor(np.log2(w)).astype(int)
    for k in sorted(set(kind.tolist()), reverse=True):
        at = np.flatnonzero(kind == k)
        each = min(max(wanted / tokens, 0.0), cap) if tokens > 0 else 0.0
        base = np.floor(each + EPS)
        p = pivotal(np.full(len(at), max(0.0, each - base)), w[at], u[at])
        loose = (p > 0) & (p < 1)
        p[loose] = v[at][loose] < p[loose]
        copies[at] = np.minimum(base + p, cap)
        wanted -= float(copies[at] @ w[at])
        tokens -= float(w[at].sum())
    return copies


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> pd.DataFrame:
    """A row a target: src, source, share, cap, n_docs, tokens, wanted (tokens), copies (a record's expected number).

    Without ``total_tokens`` the mix is the largest in which every source that has tokens gets exactly
    its share; sources without any are left to report a share of 0. Otherwise a source is capped.
    """
    plan = targets.join(sizes.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "src", "left").orderBy("src").toPandas()
    plan[["n_docs", "tokens"]] = plan[["n_docs", "tokens"]].fillna(0)
    room = plan["cap"] * plan["tokens"]
    there = (room > 0) & (plan["share"] > 0)
    total = total_tokens if total_tokens is not None else float((room[there] / plan["share"][there]).min()) if there.any() else 0.0
    plan["wanted"] = np.where(there, np.minimum(plan["share"] * total, room), 0.0)
    plan["copies"] = np.where(there, plan["wanted"] / plan["tokens"].where(there, 1), 0.0)
    return plan


def mix_sources(
    docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, t_source: str, t_share: str, t_cap: str,
    tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 0,
) -> tuple[DataFrame, pd.DataFrame]:
    """(rows doc_id, src, source, n_tokens, copies of every record of a target's source, plan).

    Records of other sources, or of none, are not used and not tokenized. Targets of one name add
    their shares and take the smaller cap; targets without a name or a positive share are left out; a
    null cap is 1. Records without tokens get the whole part of their copies, or one more at random.
    The targets, one row a source, come to the driver. Repeated rows are records of their own.
    """
    spark = docs.sparkSession
    t = targets.select(source_key(F.col(t_source)).alias("src"), F.trim(t_source).alias("source"), F.col(t_share).cast("double").alias("share"), F.coalesce(F.col(t_cap), F.lit(1)).alias("cap"))
    t = t.where("src is not null and share > 0 and cap >= 0").groupBy("src").agg(F.min("source").alias("source"), F.sum("share").alias("share"), F.min("cap").alias("cap"))
    rows = docs.select(F.col(key).alias("doc_id"), source_key(F.col(source)).alias("src"), F.col(text).alias("text")).join(F.broadcast(t.select("src")), "src", "left_semi")
    sizes = cut(token_counts(rows, "text", tokenizer))
    plan = mix_plan(sizes, t, total_tokens)
    fields = "src string, source string, wanted double, cap int, large double, n_buckets int"
    known = [(r.src, r.source, float(r.wanted), int(r.cap), LARGE * r.tokens, max(1, int(-(-r.n_docs // BUCKET)))) for r in plan.itertuples()]
    state = sizes.join(F.broadcast(spark.createDataFrame(known, fields)), "src").withColumn("draw", F.xxhash64("doc_id", "n_tokens", F.lit(seed)))
    kept = ["doc_id", "src", "source", "n_tokens", "copies"]
    kinds = dict(sizes.dtypes) | {"source": "string", "copies": "int", "p": "double", "draw": "bigint", "bucket": "int"}
    schema = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def draws(frame: pd.DataFrame, level: int) -> np.ndarray:
        mixed = frame["draw"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53

    def large(_: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        copies = cascade(frame["n_tokens"].to_numpy(float), float(frame["wanted"].iloc[0]), float(frame["all_tokens"].iloc[0]), int(frame["cap"].iloc[0]), draws(frame, 0), draws(frame, 1))
        yield frame.assign(copies=copies.astype(np.int32))[kept]

    totals = spark.createDataFrame([(r.src, float(r.tokens)) for r in plan.itertuples()], "src string, all_tokens double")
    big = state.where("n_tokens > large").join(F.broadcast(totals), "src")
    big = cut(map_groups(big.select("doc_id", "src", "source", "n_tokens", "wanted", "all_tokens", "cap", "draw"), ["src"], large, schema(kept), ["n_tokens", "draw", "doc_id"]))
    given = {r.src: (r.given, r.held) for r in big.groupBy("src").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("given"), F.sum("n_tokens").alias("held")).collect()}
    left = []
    for r in plan.itertuples():
        got, held = given.get(r.src, (0, 0))
        left.append((r.src, float(min(max((r.wanted - got) / (r.tokens - held), 0.0), r.cap)) if r.tokens > held else 0.0))
    small = state.where("n_tokens <= large").join(F.broadcast(spark.createDataFrame(left, "src string, each double")), "src")
    base = F.floor(F.col("each") + EPS)
    names = [*kept, "p", "draw", "bucket"]
    small = small.withColumns({"copies": base.cast("int"), "p": F.greatest(F.lit(0.0), F.col("each") - base), "bucket": F.pmod("draw", F.col("n_buckets")).cast("int")}).select(*names)

    def rounder(level: int):
        def run(_: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            p, w, u = frame["p"].to_numpy(float).copy(), frame["n_tokens"].to_numpy(float), draws(frame, level)
            none = w <= 0
            p[none] = u[none] < p[none]
            p[~none] = pivotal(p[~none], w[~none], u[~none])
            yield frame.assign(p=p)[names]

        return run

    done, level, most = [big], 2, max([1, *(k[-1] for k in known)])
    while True:
        small = cut(map_groups(small, ["src", "bucket"], rounder(level), schema(names), ["draw", "doc_id"]))
        last = most <= 1
        # the one residual of a source is settled by its own draw
        whole = small if last else small.where("p = 0 or p = 1")
        chance = (F.pmod(F.xxhash64("draw", F.lit("last")), F.lit(1 << 30)) / (1 << 30)) < F.col("p")
        done.append(whole.withColumn("copies", F.col("copies") + F.when(F.col("p").isin(0.0, 1.0), F.col("p").cast("int")).otherwise(chance.cast("int"))).select(*kept))
        if last:
            break
        small = small.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        most, level = -(-most // FAN_IN), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, plan


def mix_shares(mixed: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """A row a target: the share wanted, and the share, tokens, records and largest number of copies reached."""
    spark = mixed.sparkSession
    schema = "src string, source string, target_share double, max_repeats int, source_docs bigint, source_tokens bigint"
    t = spark.createDataFrame([(r.src, r.source, float(r.share), int(r.cap), int(r.n_docs), int(r.tokens)) for r in plan.itertuples()], schema)
    got = mixed.groupBy("src").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_docs"), F.max("copies").alias("most_repeats"))
    total = got.agg(F.sum("mix_tokens").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    share = F.coalesce(F.try_divide(F.coalesce("mix_tokens", F.lit(0)).cast("double"), F.col("total")), F.lit(0.0)).alias("actual_share")
    return t.join(got, "src", "left").join(F.broadcast(total)).select("source", "target_share", share, "max_repeats", zero("most_repeats"), "source_docs", "source_tokens", zero("mix_docs"), zero("mix_tokens"))


def mix_audit(mixed: DataFrame, plan: pd.DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """A row a target: source, source_docs, and whether its records are all there once, none is used too often, and its share is reached.

    The share wanted is that among the targets that have tokens; it is reached to within ``tolerance`` of the whole.
    """
    shares = mix_shares(mixed, plan)
    rows = mixed.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))
    there = float(plan.loc[(plan["tokens"] > 0) & (plan["cap"] > 0), "share"].sum()) or 1.0
    wanted = F.when((F.col("source_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share") / there).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return shares.join(rows, "source", "left").select(
        "source", "source_docs", ((zero("rows") == F.col("source_docs")) & (zero("ids") == F.col("source_docs"))).alias("whole"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_held"), (F.abs(F.col("actual_share") - wanted) <= tolerance).alias("share_reached"),
    )

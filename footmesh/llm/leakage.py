"""Evaluation texts leaking into training text (problem 6).

The test items form a BM25 inverted index with block-max bounds. Every document is cut into
overlapping passages, each of which is a query of the index; items that score at least their own
threshold are verified word by word. A run of RUN words lies whole in one of the passages, since these
are 2 * RUN words long and begin every RUN words; and an item's threshold is the least score that
any run of RUN of its words gives, so retrieval loses no leak. Documents stay where they are read:
the index goes to them, and only hits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmesh.llm.lookalike import Maps, normal_texts, shared_maps

RUN = 20
K1, B = 1.2, 0.75
# Items of a block, whose bound is kept for every term; a block that is small is passed over more often.
BLOCK = 4
# An index is built of about so many characters of items at most. More items make more indexes, of which SENT go to the documents in one pass.
INDEX_CHARS = 1_000_000
SENT = 16

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters or digits of a text in normal form, without case."""
    return WORD.findall(text.casefold())


class ItemIndex:
    """BM25 postings of the items by term, with the largest impact of each block of items."""

    def __init__(self, ids: list, texts: list[str], run: int = RUN, maps: Maps | None = None):
        self.ids, self.run = ids, run
        docs = [words_of(t) for t in normal_texts(texts, maps)]
        self.vocab: dict[str, int] = {}
        coded = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in d], np.int32) for d in docs]
        n, size = len(docs), len(self.vocab)
        mean = max(1.0, float(np.mean([len(d) for d in coded])) if coded else 1.0)
        term, item, impact = [], [], []
        df = np.zeros(size)
        for d in coded:
            df[np.unique(d)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.threshold = np.full(n, np.inf)
        self.runs: dict[bytes, list[int]] = {}
        for k, d in enumerate(coded):
            terms, tf = np.unique(d, return_counts=True)
            w = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
            term.append(terms)
            item.append(np.full(len(terms), k))
            impact.append(w)
            own = dict(zip(terms.tolist(), w.tolist()))
            for s in range(len(d) - run + 1):
                piece = d[s : s + run]
                self.threshold[k] = min(self.threshold[k], sum(own[t] for t in set(piece.tolist())))
                self.runs.setdefault(piece.tobytes(), []).append(k)
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
        term, item, impact = cat(term, np.int64), cat(item, np.int64), cat(impact, float)
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], impact[order], term[order]
        self.start = np.searchsorted(term, np.arange(size + 1))
        self.blocks = (n + BLOCK - 1) // BLOCK
        # bounds by term and block, only where the block has the term; the last term is for words that no item has
        where = term * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.empty(0, int)
        self.bound = np.maximum.reduceat(self.impact, first).astype(np.float32) if len(first) else np.empty(0, np.float32)
        self.bound_block = (self.item[first] // BLOCK).astype(np.int32)
        self.bound_start = np.searchsorted(term[first], np.arange(size + 2))
        # the least threshold of each block and of all; a term's largest impact of all
        self.block_least = np.array([self.threshold[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.blocks)])
        self.least = self.threshold.min() if n else np.inf
        self.top = np.zeros(size + 1)
        if size:
            self.top[:size] = np.maximum.reduceat(self.impact, self.start[:-1])

    def upper(self, distinct: np.ndarray) -> np.ndarray:
        """By passage and block the sum of the bounds of the passage's terms."""
        count = self.bound_start[distinct + 1] - self.bound_start[distinct]
        passage = np.repeat(np.arange(len(distinct)), count.sum(1))
        begin = np.repeat(self.bound_start[distinct].ravel(), count.ravel())
        within = np.arange(len(begin)) - np.repeat(np.r_[0, np.cumsum(count.ravel())[:-1]], count.ravel())
        at = begin + within
        return np.bincount(passage * self.blocks + self.bound_block[at], self.bound[at], len(distinct) * self.blocks).reshape(len(distinct), self.blocks)

    def candidates(self, terms: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Items of the live blocks whose score for the passage of these distinct terms reaches their threshold."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms]
        item, impact = np.concatenate([self.item[s] for s in spans]), np.concatenate([self.impact[s] for s in spans])
        kept = live[item // BLOCK]
        score = np.bincount(item[kept], impact[kept], len(self.ids))
        return np.flatnonzero(score >= self.threshold - 1e-6)

    def hits(self, words: list[str]) -> set[int]:
        """Items of which the words hold a run, by number."""
        run, out = self.run, set()
        if len(words) < run or not len(self.ids):
            return out
        get, none = self.vocab.get, len(self.vocab)
        codes = np.array([get(w, none) for w in words], np.int32)
        total = np.r_[0.0, np.cumsum(self.top[codes])]
        begin = np.arange(0, len(codes) - run + 1, run)
        # a passage whose words could not reach any threshold is not searched
        begin = begin[total[np.minimum(begin + 2 * run, len(codes))] - total[begin] >= self.least - 1e-6]
        padded = np.r_[codes, np.full(2 * run, none, np.int32)]
        for at in range(0, len(begin), 256):
            start = begin[at : at + 256]
            distinct = np.sort(padded[start[:, None] + np.arange(2 * run)], axis=1)
            distinct[:, 1:][distinct[:, 1:] == distinct[:, :-1]] = none
            # blocks whose bounds stay below all thresholds of their items are passed over
            live = self.upper(distinct) >= self.block_least - 1e-3
            for k in np.flatnonzero(live.any(1)):
                terms = distinct[k][distinct[k] < none]
                wanted = set(self.candidates(terms, live[k]).tolist())
                if wanted:
                    piece = codes[start[k] : start[k] + 2 * run]
                    for s in range(len(piece) - run + 1):
                        out.update(i for i in self.runs.get(piece[s : s + run].tobytes(), ()) if i in wanted)
        return out


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """doc_id, item_id: documents that hold at least ``run`` consecutive words of an item, each pair once.

    Items shorter than that, null texts and null keys match nothing. Items are indexed by parts of about
    INDEX_CHARS characters, whatever their number; every SENT indexes take one pass over the documents.
    """
    items = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // INDEX_CHARS))
    rows = docs.select(F.col(doc_key).alias("doc_id"), F.col(doc_text).alias("t")).where("doc_id is not null and t is not null")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(items.dtypes)['id']}"
    spark = docs.sparkSession
    maps = shared_maps(spark)
    out = None
    for first in range(0, parts, SENT):
        indexes = []
        for part in range(first, min(parts, first + SENT)):
            block = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).orderBy("id", "t").toPandas()
            indexes.append(ItemIndex(block["id"].tolist(), block["t"].tolist(), run, maps.value))
        shared = spark.sparkContext.broadcast(indexes)

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            indexes = shared.value
            for frame in frames:
                docs_out, items_out = [], []
                for doc, text in zip(frame["doc_id"], normal_texts(frame["t"].tolist(), maps.value)):
                    words = words_of(text)
                    for index in indexes:
                        for k in index.hits(words):
                            docs_out.append(doc)
                            items_out.append(index.ids[k])
                yield pd.DataFrame({"doc_id": docs_out, "item_id": items_out}, dtype=object if not docs_out else None)

        found = rows.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()

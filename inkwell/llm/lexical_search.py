"""Ranked lexical search with pipelined term partitioning.

The query terms' postings are divided among owners by the share of documents that hold a term, the
rarest first. An item bundle (an item, and its accumulators of one block of documents) passes through
the owners one after the other: each is a cogroup of the block's bundles with the block's postings of the
owner's terms, which adds the terms' integer contributions to the bundle's sparse accumulators.

Between two owners every item's k-th best partial score is known, a lower bound of what the k-th best
document will have. A document whose accumulator and all that later owners can add
stay below it is given up, and so is one without an accumulator; documents that could still tie
stay. The last owner leaves each block's best, from which the final selection is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._text import folded_codes, gather, runs, small_batches, span_hashes, text_bytes, windows
from inkwell.session import materialize, working_tables

BLOCK_DOCS = 4096
OWNER_SHARES = (1 / 256, 1 / 32, 1 / 8)  # terms in at most this share of documents belong to this owner, others to the last
PREFILTER_TERMS = 1 << 20  # query terms up to which their hashes (8 MB) are sent to the tasks; beyond, only the join filters
FOLDED = folded_codes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

GROUP = "block int, item_key long, rest long, docs array<long>, ids array<long>, scores array<long>"


def term_lists(texts: DataFrame, hashes: np.ndarray | None = None) -> DataFrame:
    """(key, id, n, terms, tfs) of ``texts`` (key, id, text) with at least one term: n counts all of its terms with
    repeats; the lists hold its distinct terms, of which ``hashes`` (ascending) may sort out those nobody asks for."""
    shared = texts.sparkSession.sparkContext.broadcast(hashes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for i, j in windows(bounds, rows=4096):
                part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                starts, ends = runs(TERM[part], at)
                row = np.searchsorted(at, starts, "right") - 1
                n = np.bincount(row, minlength=j - i)
                if wanted is not None and len(starts):
                    hashed = span_hashes(part, starts, ends, FOLDED)
                    place = np.minimum(np.searchsorted(wanted, hashed), max(len(wanted) - 1, 0))
                    keep = wanted[place] == hashed if len(wanted) else np.zeros(len(hashed), bool)
                    starts, ends, row = starts[keep], ends[keep], row[keep]
                lengths = ends - starts
                spans = gather(LOWER[part], starts, lengths)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(spans)).dictionary_encode()
                size = max(len(terms.dictionary), 1)
                pair, tf = np.unique(row * size + terms.indices.to_numpy().astype(np.int64), return_counts=True)
                stops = np.concatenate(([0], np.cumsum(np.bincount(pair // size, minlength=j - i)))).astype(np.int32)
                held = pa.array(n > 0)
                columns = [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(stops), pc.cast(terms.dictionary.take(pa.array(pair % size)), pa.string())),
                    pa.ListArray.from_arrays(pa.array(stops), pa.array(tf, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([pc.filter(c, held) for c in columns], ["key", "id", "n", "terms", "tfs"])

    return small_batches(texts).mapInArrow(listed, "key long, id long, n long, terms array<string>, tfs array<long>")


def _keyed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of their own, as ids may be NULL or repeat. It is fixed once what is made of it has been written."""
    return table.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def term_hashes(terms: list[str]) -> np.ndarray:
    """The terms' hashes, ascending."""
    data, bounds = text_bytes(pa.array(terms, pa.string()))
    return np.sort(span_hashes(data, bounds[:-1], bounds[1:]))


def postings(lists: DataFrame, asked: DataFrame, block_docs: int, shares: tuple) -> tuple[DataFrame, DataFrame]:
    """(owner, block, term_id, key, id, gain) of every query term, and (term, term_id, owner, most) of the terms themselves.

    ``gain`` is what the term adds to an item's score in that document, ``most`` the largest of its gains."""
    total = lists.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 1
    rows = lists.select("key", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("key", "id", "n", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(shares))
    for i in reversed(range(len(shares))):
        owner = F.when(F.col("df") <= shares[i] * n_docs, i).otherwise(owner)
    terms = materialize(df.join(asked, "term").select("term", "term_id", owner.alias("owner"), weight.alias("w")), "search-terms")
    m = f"100 - 90 + ((90 * n * {n_docs}L) div {n_terms}L)"
    blocks = max(1, -(-n_docs // block_docs))
    gained = rows.join(terms.where("w > 0"), "term").select(
        "owner", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "term_id", "key", "id", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * ({m})))").alias("gain")
    )
    index = materialize(gained, "search-postings")
    most = index.groupBy("term_id").agg(F.max("gain").alias("most"))
    return index, materialize(terms.join(most, "term_id").select("term", "term_id", "owner", "most"), "search-terms")


def _bundles(of_terms: DataFrame, owner: int) -> DataFrame:
    """(item_key, own: its terms at this owner, rest: what later owners can add at most)."""
    own = F.collect_list(F.when(F.col("owner") == owner, F.col("term_id")))
    rest = F.sum(F.when(F.col("owner") > owner, F.col("most")).otherwise(0))
    return of_terms.groupBy("item_key").agg(own.alias("own"), rest.alias("rest"))


def _stage(k: int, last: bool):
    def added(bundles: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The bundles of one block after one owner."""
        kept = [np.concatenate([np.asarray(x, np.int64) for x in bundles[name]]) if len(bundles) else np.zeros(0, np.int64) for name in ("docs", "ids")]
        keys, first = np.unique(np.concatenate((kept[0], found["key"].to_numpy(np.int64))), return_index=True)
        id_at = np.concatenate((kept[1], found["id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)))[first]
        order = np.argsort(found["term_id"].to_numpy(np.int64), kind="stable")
        term = found["term_id"].to_numpy(np.int64)[order]
        place = np.searchsorted(keys, found["key"].to_numpy(np.int64)[order])
        gain = found["gain"].to_numpy(np.int64)[order]
        rows = []
        for b in bundles.itertuples(index=False):
            score = np.zeros(len(keys), np.int64)
            score[np.searchsorted(keys, np.asarray(b.docs, np.int64))] = b.scores
            for t in b.own:
                i, j = np.searchsorted(term, (t, t + 1))
                score[place[i:j]] += gain[i:j]
            bar = max(int(b.bar), 1)
            if (score >= bar).sum() > k:
                bar = max(bar, int(np.partition(score, len(score) - k)[len(score) - k]))
            held = np.flatnonzero((score > 0) & (score + b.rest >= bar))
            if last and len(held) > k:
                held = held[np.lexsort((keys[held], id_at[held], -score[held]))[:k]]
            if len(held) or b.rest >= bar:
                rows.append((b.block, b.item_key, b.rest, keys[held], id_at[held], score[held]))
        return pd.DataFrame(rows, columns=["block", "item_key", "rest", "docs", "ids", "scores"])

    return added


def search(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_docs: int = BLOCK_DOCS,
    shares: tuple = OWNER_SHARES,
    prefilter: int = PREFILTER_TERMS,
) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score. Scores are above 0; equal ones by ascending doc_id.

    NULL and empty texts hold no terms: such items have no rows, such documents are in no count. Rows that repeat
    an item_id are ranked one by one, rows that repeat a doc_id are documents of their own, and a NULL doc_id comes
    last among equal scores. Empty tables give no rows. Other columns are not read."""
    spark = docs.sparkSession
    with working_tables(spark) as work:
        asked_lists = materialize(term_lists(_keyed(items, item_id, item_text)), "search-items")
        asked = asked_lists.select(F.explode("terms").alias("term")).distinct()
        asked = materialize(asked.select("term", F.monotonically_increasing_id().alias("term_id")), "search-asked")
        hashes = None
        if asked.count() <= prefilter:
            hashes = term_hashes([row[0] for row in asked.select("term").toLocalIterator()])
        lists = materialize(term_lists(_keyed(docs, id_col, text_col), hashes), "search-lists")
        index, terms = postings(lists, asked, block_docs, shares)
        blocks = (index.agg(F.max("block")).first()[0] or 0) + 1

        of_terms = asked_lists.select(F.col("key").alias("item_key"), F.explode("terms").alias("term")).join(terms, "term")
        of_terms = materialize(of_terms.select("item_key", "term_id", "owner", "most"), "search-items")
        none = F.array().cast("array<long>")
        state = of_terms.select("item_key").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        state = state.select("block", "item_key", none.alias("docs"), none.alias("ids"), none.alias("scores"))
        bars = of_terms.groupBy("item_key").agg(F.lit(1).cast("long").alias("bar"))
        table = None
        for owner in range(len(shares) + 1):
            sent = state.join(_bundles(of_terms, owner), "item_key").join(bars, "item_key").select("block", "item_key", "docs", "ids", "scores", "own", "rest", "bar")
            found = index.where(F.col("owner") == owner).select("block", "term_id", "key", "id", "gain")
            passed = sent.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_stage(k, owner == len(shares)), GROUP)
            before, table = table, materialize(passed, "search-bundles")
            if before is not None:
                work.drop(before)
            state = table.drop("rest")
            best = state.select("item_key", F.explode(F.slice(F.sort_array("scores", asc=False), 1, k)).alias("bar"))
            order = Window.partitionBy("item_key").orderBy(F.desc("bar"))
            kth = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy("item_key").agg(F.min("bar").alias("bar"), F.count("*").alias("_n"))
            known = kth.select("item_key", F.when(F.col("_n") == k, F.col("bar")).otherwise(1).alias("bar"))
            bars = of_terms.select("item_key").distinct().join(known, "item_key", "left").select("item_key", F.coalesce("bar", F.lit(1)).alias("bar"))
        every = state.select("item_key", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("_d")).select("item_key", "_d.*")
        order = Window.partitionBy("item_key").orderBy(F.desc("scores"), "ids", "docs")
        ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = ranked.join(asked_lists.select(F.col("key").alias("item_key"), F.col("id").alias("item_id")), "item_key")
        doc_id = F.nullif("ids", F.lit(np.iinfo(np.int64).max).cast("long"))
        return work.keep(named.select("item_id", "rank", doc_id.alias("doc_id"), F.col("scores").alias("score")), "search")

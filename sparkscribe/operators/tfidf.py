"""Exact TF-IDF cosine top-k with early stop: block-maximum postings and MaxScore inside each shard of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.operators.quality import ASKED, words
from sparkscribe.sources.staging import bound_batches, staged

#: Postings of a shard, (query, term) pairs of a part, postings of a block.
SHARD, PART, BLOCK = 1 << 20, 1 << 17, 128
#: A term of at most so many characters that makes up more than one in COMMON of all postings is broadcast: fewer than COMMON are.
COMMON, LONG = 1 << 19, 64


class Postings:
    """Documents and weights of each term, by document; the largest weight of each block of a term and of the term."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        by = np.lexsort((doc, term))
        self.doc, self.weight, self.block = doc[by], weight[by], block
        self.terms, self.start = np.unique(term[by], return_index=True)
        self.stop = np.append(self.start[1:], len(by))
        self.top = np.maximum.reduceat(self.weight, self.start) if len(by) else np.zeros(0)
        edges = [np.arange(a, b, block) for a, b in zip(self.start, self.stop)]
        self.first = np.cumsum([0] + [len(e) for e in edges])
        self.blocks = np.concatenate(edges) if edges else np.zeros(0, int)
        self.best = np.maximum.reduceat(self.weight, self.blocks) if len(by) else np.zeros(0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores among which the k best are, and the number of postings scored.

        Terms are taken in falling order of their largest contribution. Once the k-th score reached exceeds what all terms left can add, no new
        document can enter: of the terms left only the blocks are opened in which a document stands that can still reach it."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, q = at[known], weights[known]
        order = np.argsort(-(q * self.top[at]), kind="stable")
        at, q = at[order], q[order]
        most = q * self.top[at]
        left = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what terms from i on can add
        total, seen, scored = np.zeros(n_docs), np.zeros(n_docs, bool), 0
        live = None
        for i in range(len(at)):
            if live is None:
                reached = total[seen]
                if len(reached) >= k:
                    least = np.partition(reached, len(reached) - k)[len(reached) - k]
                    if left[i] < least - 1e-9:
                        live = np.flatnonzero(seen)
            low, high = self.start[at[i]], self.stop[at[i]]
            if live is None:
                doc = self.doc[low:high]
                total[doc] += q[i] * self.weight[low:high]
                seen[doc] = True
                scored += high - low
                continue
            least = np.partition(total[live], len(live) - k)[len(live) - k]
            live = live[total[live] + left[i] >= least - 1e-9]
            # where each document left would stand, and the best of its block
            spot = low + np.searchsorted(self.doc[low:high], live)
            found = spot < high
            found[found] = self.doc[spot[found]] == live[found]
            block = self.first[at[i]] + (spot - low) // self.block
            block = np.minimum(block, self.first[at[i] + 1] - 1)
            hope = total[live] + q[i] * self.best[block] + left[i + 1] >= least - 1e-9
            use = found & hope
            total[live[use]] += q[i] * self.weight[spot[use]]
            scored += int(use.sum())
            live = live[hope | ~found]
        docs = np.flatnonzero(seen) if live is None else live
        return docs, total[docs], scored


def _counted(docs: DataFrame) -> DataFrame:
    """(key, term, tf) of (key, words), row by row, without a shuffle."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            terms = batch.column(1).flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            pair, times = np.unique(row * max(1, len(terms.dictionary)) + terms.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(pair, max(1, len(terms.dictionary)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.dictionary.take(pa.array(term)), pa.array(times)], ["key", "term", "tf"])

    return docs.mapInArrow(count, f"key {dict(docs.dtypes)['key']}, term string, tf long")


def tfidf_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str, text_col: str, query_id: str, query_text: str, shard: int = SHARD, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score, scored, postings): cosine of the TF-IDF vectors of a query and a document that share a term.

    A term's weight is its number in the text times ln((1 + n) / (1 + df)) + 1, n and df over all documents; vectors have length one. Scores are
    rounded to 9 places for the order, ties go to the smaller id. scored: postings whose product was formed for the query, of `postings` that its terms
    have. Ids are unique longs or strings; null texts have no words, and a text or query without words no row; an empty table gives none.

    A document's words are counted where it is read and written once; of all its terms only those that are not common are shuffled, for its length, and
    only the queries' terms go on, as numbers. Documents are dealt over shards of about `shard` postings and queries over parts of about `part` terms;
    each pair is one task of bounded size.
    """
    if k < 1:
        raise ValueError("k must be positive")
    bound_batches(docs.sparkSession)
    rows = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), F.max(F.col(id_col).isNull().cast("int")).alias("null")).first()
    n = F.lit(rows.n)
    idf = F.ln((1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    tf = _counted(docs.select(F.col(id_col).alias("key"), words(text_col).alias("words")))
    if rows.ids + (rows.null or 0) < rows.n:  # rows that repeat an id count as one document
        tf = tf.groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    tf = staged(tf)
    df = staged(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    asked = queries.select(F.col(query_id).alias("key"), F.explode(words(query_text)).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = asked.join(df, "term", "left").withColumn("w", F.col("tf") * idf)
    asked = staged(asked.select("key", "term", "df", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))).alias("w"), F.xxhash64("key").alias("h")))
    pairs = asked.count()
    small = F.broadcast if pairs <= ASKED else lambda x: x
    wanted = staged(asked.select("term", "df").distinct().withColumn("no", F.monotonically_increasing_id()))
    total, every = wanted.agg(F.sum("df")).first()[0] or 0, df.agg(F.sum("df")).first()[0] or 0
    common = F.broadcast(df.where((F.col("df") > every // COMMON) & (F.length("term") <= LONG)))
    known = tf.where(F.col("key").isNotNull())
    weight = F.col("tf") * idf
    squares = known.join(common, "term").select("key", (weight * weight).alias("w")).unionByName(known.join(common, "term", "left_anti").join(df, "term").select("key", (weight * weight).alias("w")))
    size = squares.groupBy("key").agg(F.sqrt(F.sum("w")).alias("w")).select("key", F.lit(-1).cast("long").alias("no"), "w")
    postings = known.join(small(wanted), "term").select("key", "no", weight.alias("w")).unionByName(size)  # lengths stand among the postings, without a term
    shards, parts = max(1, -(-total // shard)), max(1, -(-pairs // part))
    left = postings.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    numbers = wanted.select("term", F.col("no").alias("own"))
    right = asked.join(small(numbers), "term").select("key", F.col("own").alias("no"), "w", F.pmod("h", F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    kinds = dict(tf.dtypes)["key"], dict(asked.dtypes)["key"]

    def search(key, rows, own):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = pa.schema([("query_id", own.schema.field("key").type), ("id", rows.schema.field("key").type), ("score", pa.float64()), ("scored", pa.int64()), ("postings", pa.int64())])
        if not len(rows) or not len(own):
            return out.empty_table()
        docs = rows["key"].combine_chunks().dictionary_encode()
        names, at = docs.dictionary, docs.indices.to_numpy()
        term, weight, size = rows["no"].to_numpy(), rows["w"].to_numpy(), np.ones(len(names))
        length = term < 0
        size[at[length]] = weight[length]
        at, term, weight = at[~length], term[~length], weight[~length]
        lists = Postings(term, at, weight / size[at], block)
        if not len(lists.terms):
            return out.empty_table()
        place = own["no"].to_numpy()
        place = np.where(np.isin(place, lists.terms), place, -1)
        asking = own["key"].combine_chunks().dictionary_encode()
        by = np.argsort(asking.indices.to_numpy(), kind="stable")
        start = np.searchsorted(asking.indices.to_numpy()[by], np.arange(len(asking.dictionary) + 1))
        weights, parts = own["w"].to_numpy(), []
        for q in range(len(asking.dictionary)):
            mine = by[start[q] : start[q + 1]]
            mine = mine[place[mine] >= 0]
            found, score, scored = lists.search(place[mine], weights[mine], k, len(names))
            many = int((lists.stop - lists.start)[np.searchsorted(lists.terms, place[mine])].sum())
            if len(found) > k:  # ties at the k-th score stay for the order by id
                keep = np.round(score, 9) >= np.partition(np.round(score, 9), len(score) - k)[len(score) - k]
                found, score = found[keep], score[keep]
            m = len(found)
            parts.append(pa.table([asking.dictionary.take(pa.array([q] * m, pa.int32())), names.take(pa.array(found)), pa.array(score), pa.array([scored] * m, pa.int64()), pa.array([many] * m, pa.int64())], schema=out))
        return pa.concat_tables(parts)

    keys = ["shard", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"query_id {kinds[1]}, id {kinds[0]}, score double, scored long, postings long")
    found = staged(found)
    # a shard tells its effort once a query
    effort = found.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("query_id", "shard").agg(F.max("scored").alias("scored"), F.max("postings").alias("postings")).groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    best = found.drop("scored", "postings").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(effort, "query_id").select("query_id", "rank", "id", "score", "scored", "postings")

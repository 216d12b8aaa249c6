"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

A target and a background bigram model of whole lower-cased words, with the same smoothing, over every word of all
documents.  A document's score is the mean over its tokens of background log probability minus target log
probability: below 0 the text is more like the target.  The models are never in one place: documents are put into
blocks, each block counts its own distinct words and word pairs, the counts are summed by 64-bit hash in buckets (as
many as blocks), and every block reads the sums of its own words and pairs.  A word or pair meets its bucket once a
block, however often it occurs, so that no bucket is hot.  Texts are stored once and never shuffled: what a block needs,
its words too, lies in a folder of its number.  Tasks get numbers of blocks and open one block at a time, so that
neither the JVM nor a worker holds the words of several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import mixed, scratch_path, texts_of, word_blocks, word_hashes
from geoloom.scratch import arrow_folder

#: Words that the uniform estimate is spread over at least; as many as there are where the documents have more.
VOCABULARY = 2048
#: Shares of the bigram, unigram and uniform estimates.
SHARES = (0.6, 0.38, 0.02)
#: Words and bytes that fill a block.
BLOCK_WORDS, BLOCK_TEXT = 1_000_000, 1 << 23
_BLOCK = "block long, row array<long>, doc_id array<long>, before array<long>, n array<long>, words binary"


def _stored(df: DataFrame, name: str, *by: str) -> str:
    """The folder in the shared one that df is written to, parted by columns."""
    path = arrow_folder(df.sparkSession, scratch_path(df.sparkSession, name))
    df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    return path


def _of_block(path: str, block: int, columns: list[str]) -> pa.Table | None:
    """What a table parted by block has for one; None if nothing."""
    files, folder = fs.FileSystem.from_uri(f"{path}/block={block}")
    if files.get_file_info(folder).type != fs.FileType.Directory:
        return None
    return pq.read_table(folder, filesystem=files, columns=columns, partitioning=None)


def _words(path: str, block: int) -> bytes:
    return _of_block(path, block, ["words"])["words"][0].as_py()


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the rows of docs (row, doc_id, text): a row a block, with the parts of its texts in order.

    A part has n words of a text; before is the hash of the word before them, 0 at the beginning.
    """

    def cut(batches):
        first, made, held, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            lists = [pa.array([c], pa.list_(pa.int64())) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *lists, pa.array([b" ".join(texts)], pa.binary())], ["block", "row", "doc_id", "before", "n", "words"])

        n_words = 0
        for batch in batches:
            for row, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                before = 0
                for words in word_blocks(data.lower()):
                    held.append((row, doc, before, len(words)))
                    if words:
                        texts.append(b" ".join(words))
                        h = xxhash.xxh64_intdigest(words[-1])
                        before = h - (1 << 64) if h >> 63 else h
                        size += len(texts[-1])
                        n_words += len(words)
                    if n_words >= BLOCK_WORDS or size >= BLOCK_TEXT or len(held) >= BLOCK_WORDS:
                        yield flush()
                        made, held, texts, size, n_words = made + 1, [], [], 0, 0
        if held:
            yield flush()

    return docs.select("row", "doc_id", "text").mapInArrow(cut, _BLOCK)


def _packed(counts: np.ndarray, kind: str, starts: np.ndarray) -> list[bytes]:
    """Columns of numbers as bytes, all lowest bytes first: small numbers then compress well.  An item for each range
    of places; starts has where each begins and, at last, where the last ends."""
    planes = np.ascontiguousarray(np.moveaxis(counts.astype(kind)[..., None].view(np.uint8), -1, 0))
    return [planes[:, :, i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]


def _unpacked(data: pa.Buffer, columns: int, kind: str) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(int(kind[2:]), -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(columns, -1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them, in 32 bits; np.unique holds several times as much."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    found = found[new]
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return found, place


def _pairs(n: list[int], before: list[int], words: bytes) -> tuple:
    """Of the words of a block: hashes of all distinct words, then two places among them for each pair of successive
    words; hashes of all distinct pairs, and the place of each pair among them."""
    keys = word_hashes(words)
    sizes = np.array(n, np.int64)
    some = sizes > 0
    begins, size = (np.cumsum(sizes) - sizes)[some], len(keys)
    keys = np.concatenate([keys, np.array(before, np.int64).view(np.uint64)[some]])
    kinds, second = _distinct(keys)
    first = np.empty(size, np.int32)
    first[1:] = second[: max(0, size - 1)]
    first[begins] = second[size:]
    second = second[:size]
    pairs = mixed(kinds)[first]
    pairs += keys[:size]
    del keys
    # mixed a part at a time: it makes several arrays of the size of its own
    for i in range(0, size, 1 << 16):
        pairs[i : i + (1 << 16)] = mixed(pairs[i : i + (1 << 16)])
    return kinds, first, second, *_distinct(pairs)


def _sums(blocks: DataFrame, texts: str, wanted: str, buckets: int) -> DataFrame:
    """block, bucket, pairs, words, kinds: for the pairs (times in all and in the target) and the words (times before and
    after another, in all and in the target) of each block in order of their hashes, how often all blocks together have
    them.  The sum of kinds is the number of distinct words; texts has the words of each block and wanted the parts of
    each that are of the target."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)

    def count(batches):
        for x in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch))):
            kinds, first, second, pairs, place = _pairs(x["n"], x["before"], _words(texts, x["block"]))
            target = np.zeros(len(x["n"]), bool)
            if places := _of_block(wanted, x["block"], ["places"]):
                target[np.concatenate(places["places"].to_pylist())] = True
            target = np.repeat(target, x["n"])
            times = lambda at, size: [np.bincount(at, minlength=size), np.bincount(at[target], minlength=size)]  # noqa: E731, B023
            out, some = [], np.zeros(buckets, bool)
            for keys, counts in ((pairs, times(place, len(pairs))), (kinds, times(first, len(kinds)) + times(second, len(kinds)))):
                starts = np.append(np.searchsorted(keys, edges), len(keys))
                steps = np.diff(keys, prepend=np.uint64(0))
                full = np.flatnonzero(starts[1:] > starts[:-1])
                steps[starts[full]] = keys[starts[full]]
                some[full] = True
                out += [_packed(steps[None], "<u8", starts), _packed(np.stack(counts), "<u4", starts)]
            del kinds, first, second, pairs, place, target, keys, counts, steps
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x["block"]] * len(at), pa.int64())] + [pa.array([v[i] for i in at], pa.binary()) for v in out], ["bucket", "block", "pairs", "pair_times", "words", "word_times"])

    def total(table: pa.Table) -> pa.Table:
        out, kinds = {}, [0] * len(table)
        for name, times, columns in (("pairs", "pair_times", 2), ("words", "word_times", 4)):
            keys = [np.cumsum(_unpacked(x.as_buffer(), 1, "<u8")[0], dtype=np.uint64) for x in table[name]]
            ends = np.cumsum([0] + [len(k) for k in keys])
            every, at = _distinct(np.concatenate(keys))
            del keys
            counts = np.concatenate([_unpacked(x.as_buffer(), columns, "<u4") for x in table[times]], axis=1)
            sums = np.stack([np.bincount(at, c, len(every)) for c in counts]).astype(np.uint64)
            if name == "words":
                kinds[0] = int((sums[2] > 0).sum())
            out[name] = pa.array(_packed(sums[:, at], "<u8", ends), pa.binary())
        return pa.table({"block": table["block"], "bucket": table["bucket"], **out, "kinds": pa.array(kinds, pa.int64())})

    counted = blocks.select("block", "before", "n").mapInArrow(count, "bucket long, block long, pairs binary, pair_times binary, words binary, word_times binary")
    return counted.groupBy("bucket").applyInArrow(total, "block long, bucket long, pairs binary, words binary, kinds long")


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of docs (doc_id, text).

    target: doc_id of the documents that the target model learns from; the background model learns from all.
    Losses are nats a token; score is target_loss - background_loss, lower is nearer to the target.  A text
    without words has no tokens and scores 0, as all do when the target is empty of words.  Rows with a null
    doc_id are scored and belong to the background only; repeated rows count each time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    cut = _blocks(docs.withColumn("row", F.monotonically_increasing_id()))
    texts = _stored(cut, "lm-blocks", "block")
    blocks = spark.read.schema(cut.schema).parquet(texts).drop("words")
    n_blocks, n_all = blocks.agg(F.count("*"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    parts = blocks.select("block", F.posexplode(F.arrays_zip("doc_id", "n")).alias("place", "p")).select("block", "place", "p.doc_id", "p.n")
    # merged at every size: ids of the target grow with the labels and must not be broadcast
    places = parts.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("places"), F.sum("n").alias("n"))
    wanted = _stored(places, "lm-target", "block")
    n_target = spark.read.schema(places.schema).parquet(wanted).agg(F.sum("n")).first()[0]
    summed = _sums(blocks, texts, wanted, max(1, n_blocks))
    sums = _stored(summed.repartition("block"), "lm-sums", "block")
    spread = max(VOCABULARY, spark.read.schema(summed.schema).parquet(sums).agg(F.sum("kinds")).first()[0] or 0)

    def score(batches):
        for x in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch))):
            losses = np.zeros((2, len(x["n"])))
            if found := _of_block(sums, x["block"], ["bucket", "pairs", "words"]):
                _, first, second, _, place = _pairs(x["n"], x["before"], _words(texts, x["block"]))
                order = np.argsort(found["bucket"].to_numpy())
                pairs, words = (np.concatenate([_unpacked(found[c][i].as_buffer(), n, "<u8") for i in order], axis=1) for c, n in (("pairs", 2), ("words", 4)))
                part = np.repeat(np.arange(len(x["n"]), dtype=np.int32), x["n"])
                for i, t in enumerate((1 if n_target else 0, 0)):
                    p = pairs[t][place] / np.maximum(words[t], 1)[first]
                    p *= SHARES[0]
                    p += (SHARES[1] * words[2 + t] / (n_target if t else n_all))[second]
                    p += SHARES[2] / spread
                    losses[i] = np.bincount(part, -np.log(p, out=p), len(x["n"]))
                del first, second, place, pairs, words, part, p, found
            yield pa.RecordBatch.from_arrays([pa.array(x[c], pa.int64()) for c in ("row", "doc_id", "n")] + [pa.array(v) for v in losses], ["row", "doc_id", "n", "near", "far"])

    scored = blocks.mapInArrow(score, "row long, doc_id long, n long, near double, far double")
    each = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("near").alias("near"), F.sum("far").alias("far"))
    loss = lambda c: F.col(c) / F.greatest("n_tokens", F.lit(1))
    return each.select("doc_id", "n_tokens", loss("near").alias("target_loss"), loss("far").alias("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))

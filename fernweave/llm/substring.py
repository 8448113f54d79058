"""Operator 8: removal of repeated word windows by compressed FM-indexes over shards.

Method, for windows of `window` words:
1. Shards. A document can't be searched in an index of the whole corpus by every other one, so windows are dealt to shards
   by their anchor, the least hash among their word q-grams: equal windows have equal anchors and meet in one shard. Which
   anchors stand more than once is counted in packed messages (exchange.py); the others settle their windows, as a window
   that stands twice has an anchor that does. Windows of a very frequent anchor are dealt singly, by their own hash, which
   splits a hot shard. Of equal runs of windows in one block of documents only the first travels, as a map-side combine.
2. Index. A shard numbers its words, one symbol a word, compared as bytes and not by hash, and builds an FM-index with a
   wavelet matrix (fm_index.py).
3. Search. The shard's documents are streamed against the index in order: backward search gives the matching statistics of
   each position up to `window` words, and a window whose interval holds two places or more is reported with it. Of the
   windows of one interval all but the first in order are repeats, and the words that they cover go.

Order is (doc_id, text hash, position). Defined results: a null or empty text has no words; a text of any length is
searched whole, in runs of at most RUN windows; a null id counts as the smallest; rows that repeat id and text are one
document and get the same result; rows that repeat an id with other texts are ordered by the texts' hashes, which settles
ties. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .exchange import MESSAGE, MESSAGE_DDL, NUMBERS, answer, from_answer, from_answers, groups, keys_of, split, to_blocks, to_sources, unzip_array, zip_array
from .fm_index import END, FMIndex
from .words import U, Texts, gram_hashes, word_bounds

WINDOW, ANCHOR = 20, 6
RUN = 64  # windows of a run at most
LANES = 1 << 14  # runs that are searched at once
SEND_BYTES = 1 << 22
HOT = 4096  # places, rounded up to a power of two, from which an anchor's windows are dealt singly
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.binary()), ("hot", pa.binary())])
BASE_DDL = "doc_id long, h long, n_words long, sha binary, anchors binary, hot binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("starts", pa.binary())])
FOUND_DDL = "doc_id long, h long, starts binary"
RUNS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("starts", pa.binary()), ("words", pa.binary())])
RUNS_DDL = "shard int, doc_id long, h long, starts binary, words binary"


#: Stands for a null id inside the operator; it is the smallest.
NO_ID = -(1 << 63)


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id (a null one as NO_ID), text and its hash; the pair of id and hash names a document."""
    return common.whole_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))


def anchors(texts: Texts, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor, document, first window (as word number), windows."""
    total, m = len(texts.hashes), window - q + 1
    n_windows = total - window + 1
    none = np.zeros(0, np.int64)
    if n_windows <= 0:
        return np.zeros(0, np.uint64), none, none, none
    grams = gram_hashes(texts.hashes, q)
    bits = U(max(1, int(len(grams)).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < m:  # the least of `have` in a row, doubled
        step = min(have, m - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & ((U(1) << bits) - U(1))).astype(np.int64)[:n_windows]
    starts = np.arange(n_windows)
    doc = np.searchsorted(texts.first, starts, side="right") - 1
    valid = starts + window <= texts.first[doc + 1]
    starts, doc, place = starts[valid], doc[valid], place[valid]
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    begin = np.flatnonzero(new)
    return grams[place[begin]], doc[begin], starts[begin], np.diff(np.concatenate((begin, [len(starts)])))


def grouped(items: Iterator, size: int) -> Iterator[list]:
    """Lists of items (…, text) with about `size` characters each."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += len(x[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repeated_anchors(docs: DataFrame, window: int, q: int, hot: int) -> DataFrame:
    """Per document: words, SHA-256 of its words joined by spaces, its anchors that stand elsewhere too (as keys_of()
    the exchange) and those of them that are hot."""
    spark = docs.sparkSession
    common.short_batches(spark)
    parts, hot_bits = common.shuffle_partitions(spark), hot.bit_length()
    blocks = 3 * parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        part = TaskContext.get().partitionId() << 32
        for number, held in enumerate(grouped(rows_of(batches), SEND_BYTES)):
            own = part + number
            raw = [t.encode() for _, _, t in held]
            texts = Texts(raw)
            values, doc, _, _ = anchors(texts, window, q)
            twice, rows = split(values, doc, len(held), own, blocks)
            local = zip_array(np.bincount(doc[twice], minlength=len(held)).astype("<u4")) + values[twice].astype("<u8").tobytes()
            head = np.column_stack([np.array([(d, h) for d, h, _ in held], np.int64), np.diff(texts.first)])
            shas = b"".join(hashlib.sha256(b" ".join(r.split())).digest() for r in raw)
            sizes = np.array([len(local) - 8 * int(twice.sum())], "<i8").tobytes()
            yield common.to_batch([*rows, (own % blocks, own, NUMBERS, zip_array(head), shas, sizes + local)], MESSAGE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, "src"):
            (_, _, _, head, shas, local), *replies = found
            head = unzip_array(head, np.int64).reshape(-1, 3)
            n, size = len(head), int(np.frombuffer(local, "<i8", 1)[0])
            values = keys_of(np.frombuffer(local, "<u8", offset=8 + size), blocks)
            often, often_bits = from_answers([(r[5], r[0]) for r in replies])
            hot_often = often[often_bits >= hot_bits]
            owners = [np.repeat(np.arange(n), unzip_array(local[8 : 8 + size], "<u4"))]
            all_values, is_hot = [values], [np.isin(values, hot_often)]
            for dest, _, _, docs_, data, _ in replies:
                owners.append(np.repeat(np.arange(n), unzip_array(docs_, "<u4")))
                value, value_bits = from_answer(data, dest)
                all_values.append(value)
                is_hot.append(value_bits >= hot_bits)
            owner, value, warm = np.concatenate(owners), np.concatenate(all_values), np.concatenate(is_hot)
            order = np.argsort(owner, kind="stable")
            value, warm = value[order], warm[order]
            ends = np.searchsorted(owner[order], np.arange(n + 1))
            rows = []
            for k in range(n):
                v, w = value[ends[k] : ends[k + 1]], warm[ends[k] : ends[k + 1]]
                rows.append((*head[k].tolist(), shas[32 * k : 32 * k + 32], np.unique(v).tobytes(), np.unique(v[w]).tobytes()))
            yield common.to_batch(rows, BASE)

    sent = with_hash(docs).select("doc_id", "h", "text").mapInArrow(send, MESSAGE_DDL)
    counted = to_blocks(sent, parts).mapInArrow(answer(True), MESSAGE_DDL)
    return common.materialize(to_sources(counted, parts).mapInArrow(gather, BASE_DDL), "anchors")


def runs(texts: DataFrame, window: int, q: int, shards: int, blocks: int) -> DataFrame:
    """texts: doc_id, h, text, anchors, hot. Runs of windows whose anchor is repeated, each with its words, dealt
    to shards; and, with shard -1, runs that are repeats because the same words came before in this block of documents."""
    common.short_batches(texts.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        items = ((d, h, a, w, t) for d, h, t, a, w in rows_of(batches))
        for held in grouped(items, SEND_BYTES):
            held.sort(key=lambda x: x[:2])
            part = Texts([b" ".join(t.encode().split()) for *_, t in held])  # one space between words
            data = part.data.tobytes()
            values, doc, start, count = anchors(part, window, q)
            keys, edges = keys_of(values, blocks), np.searchsorted(doc, np.arange(len(held) + 1))
            keep, warm = (np.concatenate([np.isin(keys[a:e], np.frombuffer(x[k], "<u8")) for x, a, e in zip(held, edges, edges[1:], strict=False)]) for k in (2, 3))
            keep |= warm
            single = np.flatnonzero(keep & warm)
            keep &= ~warm
            shard = (values[keep] % U(shards)).astype(np.int64)
            shard, doc_, start_, count_ = cut_runs(shard, doc[keep], start[keep], count[keep])
            if len(single):
                each = np.repeat(start[single], count[single]) + ranges(count[single])
                hashes = gram_hashes(part.hashes, window)[each]
                shard = np.concatenate([shard, (hashes % U(shards)).astype(np.int64)])
                doc_, start_ = np.concatenate([doc_, np.repeat(doc[single], count[single])]), np.concatenate([start_, each])
                count_ = np.concatenate([count_, np.ones(len(each), np.int64)])
            order = np.argsort(start_, kind="stable")
            seen: set[bytes] = set()
            rows: dict[tuple[int, int], list] = {}
            first, starts, ends = part.first, part.starts, part.ends
            for s, d, a, n in zip(shard[order].tolist(), doc_[order].tolist(), start_[order].tolist(), count_[order].tolist(), strict=True):
                words = data[starts[a] : ends[a + n + window - 2]]
                if words in seen:
                    s = -1
                else:
                    seen.add(words)
                rows.setdefault((s, d), []).append((a - int(first[d]), n, words))
            yield common.to_batch([(s, held[d][0], held[d][1], np.array([(a, n) for a, n, _ in x], "<i8").tobytes(), b"" if s < 0 else zstandard.compress(b"\n".join(w for *_, w in x), 1)) for (s, d), x in rows.items()], RUNS)

    return texts.select("doc_id", "h", "text", "anchors", "hot").mapInArrow(send, RUNS_DDL)


def cut_runs(shard: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of more than RUN windows as several."""
    pieces = -(-count // RUN)
    which, k = np.repeat(np.arange(len(count)), pieces), ranges(pieces)
    return shard[which], doc[which], start[which] + RUN * k, np.minimum(count[which] - RUN * k, RUN)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 … count-1 for each count, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def symbols_of(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of runs (white space between them is one sign) as symbols from 2, equal where the bytes are, and the number of
    words before each run."""
    data = np.frombuffer(b"\n".join([*runs, b""]), np.uint8).copy()
    starts, _ = word_bounds(data)
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(starts, np.concatenate(([0], breaks + 1)))
    data[breaks] = 32  # so that a word is the same at the end of a run
    offsets = np.append(starts, len(data))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + END + 1, first


def shard_repeats(symbols: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """For runs of symbols (run k from first[k] to first[k + 1]) in ascending order of their places: which of their windows
    also start earlier. Windows are counted run by run."""
    lengths = np.diff(first)
    text = np.full(len(symbols) + len(lengths), END, np.int64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols
    index, windows = FMIndex(text, window), lengths - window + 1
    found = np.concatenate([index.matches(symbols, first[a : a + LANES], windows[a : a + LANES]) for a in range(0, len(lengths), LANES)] or [np.zeros(0, np.int64)])
    out = found >= 0
    hits = np.flatnonzero(out)
    _, earliest = np.unique(found[hits], return_index=True)
    out[hits[earliest]] = False
    return out


def repeats(dealt: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, starts): the windows of the runs that also start earlier. Runs come sorted by shard; a task holds one shard
    at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for shard, rows in shards_of(batches):
            rows.sort(key=lambda r: r[1:3])
            spans = [np.frombuffer(r[3], "<i8").reshape(-1, 2) for r in rows]
            flat = np.concatenate(spans)
            start = np.repeat(flat[:, 0], flat[:, 1]) + ranges(flat[:, 1])
            if shard < 0:
                repeat = np.ones(len(start), bool)
            else:
                symbols, first = symbols_of([w for r in rows for w in zstandard.decompress(r[4]).split(b"\n")])
                repeat = shard_repeats(symbols, first, window)
            edges = np.concatenate(([0], np.cumsum([int(s[:, 1].sum()) for s in spans])))
            out = []
            for k, r in enumerate(rows):
                own = start[edges[k] : edges[k + 1]][repeat[edges[k] : edges[k + 1]]]
                if len(own):
                    out.append((r[1], r[2], own.astype("<i8").tobytes()))
            yield common.to_batch(out, FOUND)

    return dealt.mapInArrow(search, FOUND_DDL)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, rows), one shard at a time; what was settled before comes batch by batch, as it needs no meeting."""
    rest: list[pa.RecordBatch] = []

    def later() -> Iterator[pa.RecordBatch]:
        yield from rest
        yield from batches

    for batch in batches:
        settled = pc.sum(pc.less(batch.column("shard"), 0)).as_py() or 0
        if settled:
            yield from groups(iter([batch.slice(0, settled)]), "shard")
        if settled < batch.num_rows:
            rest.append(batch.slice(settled))
            break
    yield from groups(later(), "shard")


def keep_words(text: str, starts: list[bytes], window: int) -> tuple[list[str], int]:
    """The words that no removed window covers, and how many words go."""
    words = WORD.findall(text)
    cover = np.zeros(len(words) + 1, np.int64)
    for s in starts:
        at = np.frombuffer(s, "<i8")
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def removals(docs: DataFrame, window: int = WINDOW, q: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(All documents: doc_id, h, n_words, sha. Those that lose words: doc_id, h, text, starts.)"""
    if q > window:
        raise ValueError("a window must be at least as long as an anchor")
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    base = repeated_anchors(docs, window, q, hot)
    marked = base.where(F.octet_length("anchors") > 0).select("doc_id", "h", "anchors", "hot")
    texts = with_hash(docs).join(marked, ["doc_id", "h"]).select("doc_id", "h", "text", "anchors", "hot").dropDuplicates(["doc_id", "h"])
    texts = common.materialize(texts, "marked")
    settled = F.col("shard") < 0
    dealt = runs(texts, window, q, 3 * parts, 3 * parts).repartition(parts, F.when(settled, F.xxhash64("doc_id", "h")).otherwise(F.col("shard").cast("long"))).sortWithinPartitions("shard")
    found = repeats(dealt, window).groupBy("doc_id", "h").agg(F.collect_list("starts").alias("starts"))
    cut = texts.join(common.materialize(found, "repeats"), ["doc_id", "h"]).select("doc_id", "h", "text", "starts")
    return base.select("doc_id", "h", "n_words", "sha"), cut


def deduplicate(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with `texts` h and kept_text, null where nothing goes)."""
    base, cut = removals(docs, window)
    ddl = "doc_id long, h long, n_removed long, kept_sha256 string, kept_text string"
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, h, text, starts in rows_of([batch]):
                kept, gone = keep_words(text, starts, window)
                joined = " ".join(kept)
                rows.append((doc, h, gone, hashlib.sha256(joined.encode()).hexdigest(), joined if texts else None))
            yield common.to_batch(rows, schema)

    done = cut.mapInArrow(apply, ddl)
    out = base.join(done, ["doc_id", "h"], "left")
    cols = [F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")]
    return out.select(*cols, *(["h", "kept_text"] if texts else []))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: windows of 20 words."""
    return deduplicate(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
last AS (SELECT words.*, max(later.i) OVER (PARTITION BY words.doc_id ORDER BY pos) AS i FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.pos),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE i >= pos - 19) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE i IS NULL OR i < pos - 19) AS left_over FROM last GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

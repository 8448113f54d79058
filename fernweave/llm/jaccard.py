"""Operator 10: n-gram Jaccard join as a blocked sparse product of documents by n-grams.

Method, with threshold t:
1. Each document's set of word n-grams is hashed. The hashes are dealt to blocks of the n-gram axis, each block
   counts in how many documents an n-gram stands and returns to each document how many of its n-grams stand in
   another one too. Only those can overlap, so a document with fewer than t * size of them has no link.
2. Equal sets are one row of the matrix from here on, represented by their smallest id.
3. Two sets that link share one of the size - ceil(t * size) + 1 n-grams that come first in a common order, the
   rarest among those rows first; the counts come from a second exchange of the same kind. Stars over those n-grams
   give the blocks of documents that must be compared.
4. In each block, products of the sparse rows give exact overlaps; parts outside the size bounds are discarded
   unseen. A block keeps the links of a spanning forest, so a group of copies never becomes all its pairs. A block
   that holds more n-grams than a task should is split and all pairs of its parts are compared.
5. Components of the links are found over the cluster.

Defined results: a null or empty text, or one without words, has the empty set and links with nothing; a text
with fewer than n words has the whole sequence as its one n-gram. Rows that repeat an id are one node with all
their links; a null id links with nothing and has a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .exchange import MESSAGE, MESSAGE_DDL, NUMBERS, answer, from_answers, groups, keys_of, split, to_blocks, to_sources, unzip_array, zip_array
from .words import U, Texts, gram_hashes, mix

#: Bytes of text hashed at once, and bytes of text whose n-grams are sent together.
TEXT_BYTES, SEND_BYTES = 1 << 20, 1 << 22
#: n-grams that one task compares; larger blocks of documents are split.
BLOCK_GRAMS = 2_000_000
COLUMNS = 4096  # n-grams multiplied at once
SOURCE_GRAMS = 500_000  # n-grams of candidate rows that are sent together
SUMMARY = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shared", pa.int64())])
SUMMARY_DDL = "doc_id long, n long, s1 long, s2 long, shared long"
ROWS_DDL = "doc_id long, n long, grams binary"
RANKED_DDL = "doc_id long, n long, first long, grams binary"
RANKED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("grams", pa.binary())])
ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, ASCII letters in lower case."""
    out: list[np.ndarray] = []
    raw = [t.encode() for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= TEXT_BYTES):
            size += len(raw[end])
            end += 1
        part = Texts(raw[at:end], lower=True)
        for k in range(end - at):
            w = part.of(k)
            out.append(np.unique(gram_hashes(w, min(n, len(w)))) if len(w) else np.zeros(0, np.uint64))
        at = end
    return out


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(grams):
        return 0, 0
    with np.errstate(over="ignore"):
        a, b = mix(grams ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(grams + U(0x14057B7EF767814F)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """Per document: set size, set signature, and how many of its n-grams stand in another document's set too
    (counted on 40 bits and the block's number, so never too few)."""
    spark = docs.sparkSession
    common.short_batches(spark)
    parts = common.shuffle_partitions(spark)
    blocks = 3 * parts

    def pack(held: list[tuple], own: int) -> pa.RecordBatch:
        sets = gram_sets([t for _, t in held], n)
        sigs = np.array([(len(s), *signature(s)) for s in sets], np.int64).reshape(-1, 3)
        _, first, same = np.unique(sigs, axis=0, return_index=True, return_inverse=True)
        once = set(first.tolist())
        alone = [s if k in once else s[:0] for k, s in enumerate(sets)]
        grams = np.concatenate(alone)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in alone])
        twice, rows = split(grams, owner, len(sets), own, blocks)
        local = np.bincount(owner[twice], minlength=len(sets))
        ids = np.array([(d or 0, d is None) for d, _ in held], np.int64)
        return common.to_batch([*rows, (own % blocks, own, NUMBERS, zip_array(np.column_stack([ids, sigs, first[same.reshape(-1)], local]).astype(np.int64)), b"", b"")], MESSAGE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        part, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, text))
                size += len(text)
                if size >= SEND_BYTES:
                    yield pack(held, part + number)
                    number, held, size = number + 1, [], 0
        if held:
            yield pack(held, part + number)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "src"):
            x, *more = (unzip_array(r[3], np.int64).reshape(-1, 7) if r[2] == NUMBERS else unzip_array(r[3], "<u4").astype(np.int64) for r in rows)
            count = (sum(more, np.int64(0)) + x[:, 6])[x[:, 5]]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0], pa.int64(), mask=x[:, 1] == 1), *(pa.array(x[:, k], pa.int64()) for k in (2, 3, 4)), pa.array(count, pa.int64())], schema=SUMMARY)

    sent = common.whole_text(docs).mapInArrow(send, MESSAGE_DDL)
    counted = to_blocks(sent, parts).mapInArrow(answer(False), MESSAGE_DDL)
    return common.materialize(to_sources(counted, parts).mapInArrow(gather, SUMMARY_DDL), "summaries")


def ranked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of each row the n-grams that another row has too, the rarest first, and how many of them are among its first
    size - ceil(t * size) + 1 n-grams (those of no other row stand before them). Rows with too few to link go."""
    spark = rows.sparkSession
    parts = common.shuffle_partitions(spark)
    blocks = 3 * parts

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        part, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(f.name).to_pylist() for f in ROWS), strict=True):
                held.append(row)
                size += row[1]
                if size >= SOURCE_GRAMS:
                    yield part + number, held
                    number, held, size = number + 1, [], 0
        if held:
            yield part + number, held

    def flat(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(g for *_, g in held), "<u8"), np.repeat(np.arange(len(held)), [n for _, n, _ in held])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, held in sources(batches):
            yield common.to_batch(split(*flat(held), len(held), own, blocks)[1], MESSAGE)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, held in sources(batches):
            head = np.array([(d, n) for d, n, _ in held], np.int64)
            yield common.to_batch([(0, own, NUMBERS, zip_array(head), b"".join(g for *_, g in held), b"")], MESSAGE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, "src"):
            (_, _, _, head, data, _), *replies = found
            ids = unzip_array(head, np.int64).reshape(-1, 2)
            value, rank = from_answers([(x, r[0]) for r in replies for x in r[4:6]])
            order = np.argsort(value, kind="stable")
            value, rank = value[order], rank[order]
            grams, at, out = np.frombuffer(data, "<u8"), 0, []
            for doc, n in ids.tolist():
                own = grams[at : at + n]
                at += n
                key = keys_of(own, blocks)
                place = np.minimum(np.searchsorted(value, key), len(value) - 1) if len(value) else np.zeros(n, np.int64)
                hit = value[place] == key if len(value) else np.zeros(n, bool)
                more = own[hit]
                least = -(-num * n // den)
                if len(more) >= least:
                    order = np.lexsort((more, rank[place[hit]]))
                    out.append((doc, n, len(more) - least + 1, more[order].astype("<u8").tobytes()))
            yield common.to_batch(out, RANKED)

    asked = to_blocks(rows.mapInArrow(send, MESSAGE_DDL), parts).mapInArrow(answer(True), MESSAGE_DDL)
    both = rows.mapInArrow(carry, MESSAGE_DDL).union(asked)
    return common.materialize(to_sources(both, parts).mapInArrow(gather, RANKED_DDL), "ranked")


def stars(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all rows which share one of their first n-grams."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g, "<u8")[:m] for m, g in zip(batch.column("first").to_pylist(), batch.column("grams").to_pylist(), strict=True)]
            ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), np.int64), [len(g) for g in grams])
            yield pa.RecordBatch.from_pydict({"gram": np.concatenate([*grams, np.zeros(0, np.uint64)]).view(np.int64), "doc": ids})

    # the least document of each n-gram is summed before the shuffle; a frequent n-gram is a skewed join side
    posts = common.materialize(rows.mapInArrow(first, "gram long, doc long"), "postings")
    least = posts.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("gram", "a")
    return posts.join(least, "gram").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()


def overlaps(rows: tuple[np.ndarray, ...], cols: tuple[np.ndarray, ...], a: int, b: int) -> np.ndarray:
    """Products of two blocks of sparse rows, each (row numbers, n-gram numbers, distinct ones): an a x b matrix of
    overlap counts. Only n-grams that both blocks have are multiplied, some thousand at a time: each product is exact in
    single precision, and their sum is of integers."""
    out = np.zeros((a, b), np.int64)
    shared = np.intersect1d(rows[2], cols[2], assume_unique=True)
    for at in range(0, len(shared), COLUMNS):
        grams = shared[at : at + COLUMNS]
        dense = []
        for (row, gram, _), n in ((rows, a), (cols, b)):
            place = np.searchsorted(grams, gram)
            hit = grams[np.minimum(place, len(grams) - 1)] == gram
            block = np.zeros((n, len(grams)), np.float32)
            block[row[hit], place[hit]] = 1
            dense.append(block)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


class Union:
    """Sets of numbered rows; labels are smallest members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low < high
            i, j, low, high = i[keep], j[keep], low[keep], high[keep]
            np.minimum.at(self.label, high, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def forest(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], num: int, den: int, block: int = 512) -> list[tuple[int, int]]:
    """(root, document) for the components of rows with den * overlap >= num * union. sizes count all n-grams of a
    row, sets may leave out those of no other row.

    The matrix of rows by n-grams is multiplied with itself block by block. n-grams of a single row are left out;
    rows lie next to those with the same least n-gram, so most blocks share few columns; blocks whose rows are all
    outside each other's size bounds, or all in one component already, are passed over.
    """
    held = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, [int(s.min()) for s in sets]))
    _, flat, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    flat, n = flat.reshape(-1), len(order)
    row = np.repeat(np.arange(n), held[order])
    keep = count[flat] > 1
    flat, row, size, union = flat[keep], row[keep], sizes[order], Union(n)
    cuts = [*range(0, n, block), n]
    part = [(row[a:e] - k, flat[a:e], np.unique(flat[a:e])) for k, a, e in zip(cuts, np.searchsorted(row, cuts[:-1]), np.searchsorted(row, cuts[1:]), strict=False)]
    for gap in range(len(part)):
        for x in range(len(part) - gap):
            y = x + gap
            i, j = slice(cuts[x], cuts[x + 1]), slice(cuts[y], cuts[y + 1])
            a, b = size[i], size[j]
            if den * min(a.max(), b.max()) < num * max(a.min(), b.min()) or (union.label[i].min() == union.label[i].max() == union.label[j].min() == union.label[j].max()):
                continue
            both = overlaps(part[x], part[y], len(a), len(b))
            p, q = np.nonzero(den * both >= num * (a[:, None] + b[None, :] - both))
            union.link(p + cuts[x], q + cuts[y])
    found = ids[order]
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, union.label, found)
    return [(int(a), int(b)) for a, b in zip(root[union.label], found, strict=True) if a != b]


def block_links(rows: DataFrame, clusters: DataFrame, num: int, den: int, most: int = BLOCK_GRAMS) -> DataFrame:
    """Links (a, b) within each cluster of rows."""
    placed = rows.join(clusters.select(F.col("node").alias("doc_id"), "component"), "doc_id")
    sizes = placed.groupBy("component").agg(F.sum(F.octet_length("grams") / 8).alias("all")).select("component", F.ceil(2 * F.col("all") / most).cast("int").alias("parts"))
    placed = placed.join(sizes, "component")
    one = F.col("parts") <= 2
    mine = F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = placed.withColumn("mine", mine).withColumn("other", F.explode(other))
    keyed = pairs.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc_id", "n", "grams").repartition(common.shuffle_partitions(rows.sparkSession), "component", "i", "j")

    def run(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("doc_id").to_pylist(), np.int64)
        found = forest(ids, np.array(group.column("n").to_pylist()), [np.frombuffer(g, "<u8") for g in group.column("grams").to_pylist()], num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return keyed.groupBy("component", "i", "j").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); texts link when
    den * overlap >= num * union of their n-gram sets."""
    known = summaries(docs, n)
    copies = known.where("doc_id IS NOT NULL AND n > 0")
    least = copies.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    equal = copies.join(least.where("a < z"), ["n", "s1", "s2"]).select("a", F.col("doc_id").alias("b"))
    wanted = copies.where(F.col("shared") * den >= F.col("n") * num).join(least, ["n", "s1", "s2"]).where("doc_id = a").select("doc_id", "n", "s1", "s2").distinct()
    rows = common.materialize(sets_of(docs, wanted, n), "rows")
    rows = ranked(rows, num, den)
    edges = stars(rows)
    links = block_links(rows, connected_components(edges), num, den)
    found = connected_components(links.union(equal))
    return known.join(found, known.doc_id == found.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of the wanted documents, each distinct set once."""
    common.short_batches(docs.sparkSession)
    key = wanted.select(F.col("doc_id").alias("id"), "s1", "s2")
    texts = common.whole_text(docs).join(key, F.col("doc_id") == F.col("id")).select("doc_id", "text", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for batch in batches:
            out = []
            for doc, s1, s2, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "s1", "s2")), gram_sets(batch.column("text").to_pylist(), n), strict=True):
                if (s1, s2) == signature(g):  # else another row with the same id
                    out.append((doc, len(g), g.astype("<u8").tobytes()))
            yield common.to_batch(out, ROWS)

    return texts.mapInArrow(run, ROWS_DDL)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: four-word shingles, 0.85."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, greatest(2, len(ws) - 2))]) AS gram FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

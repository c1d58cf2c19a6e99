"""Near copies by a set-similarity self-join on word shingles, with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .components import components
from .dealing import dealt
from .text import grams, mix, slices, utf8, word_hashes, words

SHINGLE = 5
#: Two sets link when SHARE * |union| <= 100 * |intersection|.
SHARE = 75
MOST_MATCHES = 4
#: Bytes of text of a chunk of rows, which a Python worker holds, and of a bucket of tokens.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, sorted by row, then hash.

    A text with words, but fewer than a shingle's, has its whole sequence as the only one.
    """
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    starts, ends, row = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    if not len(row):
        return row, hashes
    parts, rows = [], []
    if len(row) >= SHINGLE:
        inside = row[SHINGLE - 1 :] == row[: len(row) - SHINGLE + 1]
        parts.append(grams(hashes, SHINGLE)[inside])
        rows.append(row[: len(row) - SHINGLE + 1][inside])
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    many = np.diff(np.append(first, len(row)))
    for n in range(1, SHINGLE):
        at = first[many == n]
        if len(at):
            parts.append(mix(grams(hashes, n)[at] + np.uint64(n)))
            rows.append(row[at])
    row, hashes = np.concatenate(rows), np.concatenate(parts)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[fresh], hashes[fresh]


def _chunk_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: row and hash of all shingles, and size and class key of each row's set."""
    data, bounds = utf8(table["text"])
    parts = []
    for a, b in slices(bounds):
        row, hashes = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        parts.append((row + a, hashes))
    row, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    size = np.bincount(row, minlength=table.num_rows)
    key = np.zeros(table.num_rows, np.uint64)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        key[row[first]] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first) + size[row[first]].astype(np.uint64))
    return row, hashes, size, key.view(np.int64)


def _first_of_class(size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows are the first of their class in the chunk; empty sets are in none."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out & (size > 0)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of the tokens fall into each of as many parts of the hash range."""
    odd = np.bincount((hashes >> np.uint64(24)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _level(count: np.ndarray) -> np.ndarray:
    """Frequencies on a scale of 4 steps for each doubling; 0 is a token of one class only."""
    return np.minimum(255, np.ceil(4 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


ASKED = "bucket int, chunk int, tokens binary, counts binary"
TOLD = "chunk int, bucket int, tokens binary, levels binary"
CLASSES = "id long, digest long, class long, n int, matches int, score double, bits array<long>, tokens array<long>, ranks array<int>, shingles array<long>"


def _frequencies(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk the frequency levels of those of its tokens that are not its own alone.

    A chunk counts a token once for each different set, and sends it once. Tokens travel as
    32 bits beside their bucket; two that fall together only share a level, which orders them.
    """

    def ask(table: pa.Table) -> pa.Table:
        row, hashes, size, key = _chunk_sets(table)
        tokens, counts = np.unique(hashes[_first_of_class(size, key)[row]], return_counts=True)
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        short = (tokens >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((short, bucket))
        bucket, short, counts = bucket[order], short[order], np.minimum(counts[order], 1 << 30).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(bucket))
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        return pa.table({
            "bucket": pa.array(bucket[cut].tolist(), pa.int32()), "chunk": pa.array([chunk] * len(cut), pa.int32()),
            "tokens": pa.array([short[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        })

    def tell(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        every, place = np.unique(np.concatenate(tokens), return_inverse=True)
        level = _level(np.bincount(place, weights=counts))
        own, at, sent, levels = level[place], 0, [], []
        for part in tokens:
            got = own[at : at + len(part)]
            sent.append(part[got > 0].tobytes())
            levels.append(got[got > 0].tobytes())
            at += len(part)
        return pa.table({"chunk": table["chunk"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()), "tokens": pa.array(sent, pa.binary()), "levels": pa.array(levels, pa.binary())})

    return chunks.groupBy("chunk").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, TOLD)


def prefix_length(n, matches):
    """Tokens that two sets of similarity SHARE % must have ``matches`` of in common."""
    return n + (-(SHARE * n) // 100) + matches


def _classes(documents: DataFrame, pieces: int, buckets: int) -> DataFrame:
    """A row for each document, with class and set size; where it is the first of its class in
    its chunk and can have a partner, also its prefix tokens with ranks, and its set."""
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(pieces)).cast("int")
    chunks = documents.select("id", "text", F.xxhash64("text").alias("digest"), chunk.alias("chunk"))

    def prefixes(table: pa.Table, told: pa.Table) -> pa.Table:
        row, hashes, size, key = _chunk_sets(table)
        leads = _first_of_class(size, key)
        keep = leads[row]
        row, hashes = row[keep], hashes[keep]
        level = np.zeros(len(row), np.uint8)
        if told.num_rows and len(row):
            known = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(t, np.uint32).astype(np.uint64) for b, t in zip(told["bucket"].to_pylist(), told["tokens"].to_pylist())]
            known, levels = np.concatenate(known), np.frombuffer(b"".join(told["levels"].to_pylist()), np.uint8)
            order = np.argsort(known)
            known, levels = known[order], levels[order]
            if len(known):
                code = ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                level = np.where(known[at] == code, levels[at], 0).astype(np.uint8)
        order = np.lexsort((hashes, level, row))
        row, hashes, level = row[order], hashes[order], level[order]
        first = np.searchsorted(row, np.arange(table.num_rows + 1))
        rank = np.arange(len(row)) - first[row]
        matches, score = np.zeros(table.num_rows, np.int32), np.zeros(table.num_rows)
        tokens, ranks, shingles, bits = ([None] * table.num_rows for _ in range(4))
        # how many sets may share each token, summed along the prefix
        weight = np.concatenate(([0.0], np.cumsum(np.where(level > 0, 2.0 ** (level / 4.0) - 1, 0.0))))
        for i in np.flatnonzero(leads).tolist():
            a, b = first[i], first[i + 1]
            n = int(b - a)
            if prefix_length(n, 1) < n + 1 and level[a + prefix_length(n, 1) - 1] == 0:
                continue  # the shortest prefix has only tokens of its own: no partner
            costs = []
            for ell in range(1, min(MOST_MATCHES, -(-SHARE * n // 100)) + 1):
                seen = weight[a + min(prefix_length(n, ell), n)] - weight[a]
                costs.append(seen + seen / ell * n / 10)
            ell = int(np.argmin(costs)) + 1
            stop = a + min(prefix_length(n, ell), n)
            use = np.flatnonzero(level[a:stop] > 0) + a
            matches[i], score[i], bits[i] = ell, float(level[a:b].mean()), _parities(hashes[a:b])
            tokens[i], ranks[i], shingles[i] = hashes[use].view(np.int64), rank[use].astype(np.int32), np.sort(hashes[a:b].view(np.int64))
        return pa.table({
            "id": table["id"].cast(pa.int64()), "digest": table["digest"].cast(pa.int64()), "class": pa.array(key, pa.int64()), "n": pa.array(size.astype(np.int32)), "matches": pa.array(matches), "score": pa.array(score), "bits": pa.array(bits, pa.list_(pa.int64())),
            "tokens": pa.array(tokens, pa.list_(pa.int64())), "ranks": pa.array(ranks, pa.list_(pa.int32())), "shingles": pa.array(shingles, pa.list_(pa.int64())),
        })

    # both uses of the chunks read one exchange
    return chunks.groupBy("chunk").cogroup(_frequencies(chunks, buckets).groupBy("chunk")).applyInArrow(prefixes, CLASSES)


def _fits(x: str, y: str, nth: Column | None = None) -> Column:
    """Whether two entries of one token can still reach the overlap that their sizes ask for.

    Were it the ``nth`` shared token (the first), it would have at most the later ones in
    common, too; and at most what the parities of both sets leave.
    """
    need = F.ceil(F.lit(SHARE) * (F.col(f"{x}.n") + F.col(f"{y}.n")) / F.lit(100 + SHARE))
    before = F.lit(0) if nth is None else nth - 1
    by_rank = before + F.least(F.col(f"{x}.n") - F.col(f"{x}.rank"), F.col(f"{y}.n") - F.col(f"{y}.rank")) >= need
    # each bit in which the parities differ is a token that only one of both has
    differ = sum((F.bit_count(F.col(f"{x}.b{k}").bitwiseXOR(F.col(f"{y}.b{k}"))) for k in range(4)), F.lit(0))
    return by_rank & (F.col(f"{x}.n") + F.col(f"{y}.n") - differ >= 2 * need)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes with ``linked``, from their whole sets."""
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("one")), "a")
    two = one.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("two")), "b")
    common = F.size(F.array_intersect("one", "two")).cast("long")
    return two.select("a", "b", (100 * common >= SHARE * (F.size("one") + F.size("two") - common)).alias("linked"))


def linked_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id, digest, class, n`` (the digest is the text's), and ``class, root`` for the classes with links.

    A token's sets are not paired with each other. First each meets only the token's most
    central set of about its size (most frequent tokens on average); what links there makes
    components. Then only sets of different components meet, counted over those shared prefix
    tokens that can be among the first few of a pair with enough overlap; a pair goes to the
    exact test if it has as many as the shorter of the two prefixes asks for. Sets in one component need no further link for their result.
    """
    spark = documents.sparkSession
    pieces, buckets = dealt(documents, CHUNK_BYTES, BUCKET_BYTES)
    path = scratch_path(spark, "ngram-classes")
    _classes(documents, pieces, buckets).write.parquet(path)
    rows = spark.read.parquet(path)
    kept = rows.where("tokens is not null")
    sets = kept.select("class", "shingles").dropDuplicates(["class"])
    parities = [F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(4)]
    each = kept.select("class", "n", "matches", "score", *parities, "tokens", "ranks").dropDuplicates(["class"])
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / SHARE))).cast("int")
    bits = [f"b{k}" for k in range(4)]
    entries = each.select("class", "n", "matches", "score", *bits, band.alias("band"), F.explode(F.arrays_zip("tokens", "ranks")).alias("e")).select("class", "n", "matches", "score", *bits, "band", F.col("e.tokens").alias("token"), F.col("e.ranks").alias("rank"))

    # sets of linked sizes lie in one or in neighbouring bands
    centre = entries.groupBy("token", "band").agg(F.max_by(F.struct("class", "n", "rank", *bits), F.struct("score", "class")).alias("c"))
    centre = centre.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "c.*")
    met = entries.alias("x").join(centre.alias("y"), ["token", "band"]).where((F.col("x.class") != F.col("y.class")) & _fits("x", "y"))
    star = met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    tested = _verified(star, sets).checkpoint(eager=True)
    roots = components(tested.where("linked")).checkpoint(eager=True)

    # what is left: prefix tokens that sets of different components share
    placed = entries.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token")
    open_ = placed.join(mixed, "token").checkpoint(eager=True)
    ell = F.least("x.matches", "y.matches")
    reach = lambda s: F.col(f"{s}.rank") < F.col(f"{s}.n") - F.ceil(F.lit(SHARE) * F.col(f"{s}.n") / 100) + ell
    sizes = (F.col("x.n") * SHARE <= F.col("y.n") * 100) & (F.col("y.n") * SHARE <= F.col("x.n") * 100)
    shared = open_.alias("x").join(open_.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & sizes & reach("x") & reach("y") & _fits("x", "y", ell))
    counted = shared.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"), ell.alias("ell")).agg(F.count("*").alias("many"))
    rest = counted.where(F.col("many") >= F.col("ell")).select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(rest, sets).where("linked").select("a", "b")
    links = tested.where("linked").select("a", "b").union(more)
    return rows.select("id", "digest", "class", "n"), components(links)


def _placed(documents: DataFrame) -> DataFrame:
    """``id, digest, n, root`` of every row; rows without id have the largest one."""
    from .anchors import NO_ID

    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    rows, roots = linked_classes(keyed)
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select("id", "digest", "n", F.coalesce("root", "class").alias("root"))


def near_copies(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id that links of similar sets reach.

    Texts with equal sets are one class and compared once. A text without words, and a null
    text, links with nothing. Rows without id take part under the largest id, and are their
    own component where they find none with an id. Repeated rows get equal results; no rows
    give no rows; other columns are not looked at.
    """
    from .anchors import NO_ID

    placed = _placed(documents).select("id", "n", "root")
    least = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    done = placed.join(least, "root", "left")
    return done.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")), F.lit(NO_ID)).alias("component_id"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, with all columns; rows without words all stay.

    It is the row of the smallest id (rows without id come last), then of the smallest digest
    of the text. Rows are told apart by id and digest, so another text under the id of a
    dropped row stays. Of rows with equal id and text any one stays.
    """
    from .anchors import NO_ID

    key = F.struct("id", "digest")
    placed = _placed(documents).where("n > 0").select("root", key.alias("key"))
    groups = placed.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("many")).where("many > 1")
    # the rows that are not alone in their component: another's first is kept, and of its repeats one
    met = placed.join(groups, "root").groupBy("key").agg(F.count("*").alias("times"), F.first(F.col("key") == F.col("first")).alias("kept"))
    fate = met.where("not kept or times > 1").select(F.col("key.id").alias("_id"), F.col("key.digest").alias("_digest"), "kept").checkpoint(eager=True)
    names = [F.col(f"_row.`{name}`") for name in documents.columns]
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_digest"), F.struct("*").alias("_row"))
    once = rows.join(fate.select("_id", "_digest"), ["_id", "_digest"], "left_anti").select(*names)
    repeated = fate.where("kept").select("_id", "_digest")
    if repeated.isEmpty():
        return once
    single = rows.join(repeated, ["_id", "_digest"]).groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return once.union(single.select(*names))

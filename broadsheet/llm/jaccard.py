"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are sets of word shingles; documents with the same set are one class, which stands for its copies
from the first step on. The incidence of classes by shingles is cut into blocks of
hash ranges; each block finds the shingles that two classes or more have, and their frequencies. A
class of n shingles that links with another must share at least ceil(t n) of them, so among its
n - ceil(t n) + 1 rarest, the deciding ones, one is shared. Classes without such a shingle have no links.

The others meet twice. First each class meets the smallest class (the head) of one of its deciding shingles, in blocks by head. Then deciding shingles whose classes
are not all in one component yet bring theirs together once more, again in blocks by head, so a block is one class and those that share a
shingle with it, never a chain of such. In a block the product of the incidence with its transpose accumulates overlap counts row by row; pairs below the bound from both
sizes, overlap >= t (|x| + |y|) / (1 + t), are discarded; rows of the largest component are left out, for all pairs that could join components have an end
outside it. A block of more than `TILE` classes is cut into tiles of its largest component and of the others, which
meet in tasks of two tiles each: within a large group of near copies work grows with its size times the number outside its largest component. A block gives the links of a spanning forest,
never all its pairs. Components are made of such links only.

Shingle hashes have 64 bits (of a text's 20,000 shingles two are the same with a chance of 1e-11), class signatures 128. All comparisons of sizes and overlaps are exact integers.

Edge cases: a null or blank text has no shingles, links with nothing and is its own component; fewer words than a shingle has are one shingle of
them all; very long texts are slices of their own, never cut; repeated rows are copies; a null id never is the smallest (a component of null ids only has none). An empty table gives no
rows. Only the id and the text are looked at, so further columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import components, join_skewed, settled

WORDS, PERCENT = 4, 85
#: Text bytes whose shingles are gathered before they are sent, classes in a tile, shingles in a hash range.
CHUNK_BYTES, TILE, RANGE_SHINGLES = 8 << 20, 512, 2 << 20
#: Classes whose first signature word another class has, at most; they are expected to be one in 10^9 at 10^10 classes.
MOST_CLASHES = 1_000_000


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value, byte by byte: like bytes side by side compress."""
    data = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out = np.empty((width, len(data)), np.uint8)
    for i in range(width):
        out[i] = data[:, i]
    return out.tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    rows, out = np.frombuffer(data, np.uint8).reshape(width, n), np.zeros((n, 8), np.uint8)
    for i in range(width):
        out[:, i] = rows[i]
    return out.reshape(-1).view("<u8")


def packed_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)), 8)


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, 8), dtype=np.uint64)


def hash_range(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit numbers each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS):
    """Distinct (document, shingle) pairs in order; set sizes and the two words of the set signatures of the documents."""
    raw = X.lower_ascii(raw)
    starts, ends, first = X.words(raw, offsets)
    hashes, docs = X.span_hashes(raw, starts, ends), len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    keys, owners = [], []
    for k in range(1, n + 1):
        m = len(hashes) - k + 1
        if m <= 0:
            break
        own = doc[:m] == doc[k - 1 :]
        if k < n:  # only of documents of just k words
            own &= np.diff(first)[doc[:m]] == k
        if own.any():
            keys.append(X.ngram_hashes(hashes, k)[own])
            owners.append(doc[:m][own])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(docs, np.int64), np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    key, owner = key[new], owner[new]
    size = np.bincount(owner, minlength=docs)
    at = X.prefix(size)
    words = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.append(np.uint64(0), np.cumsum(X.mix(key + np.uint64(salt)), dtype=np.uint64))
        words.append(X.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)))
    return owner, key, size.astype(np.int64), *words


def class_numbers(sig: np.ndarray, sig2: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The first signature word, or another number for the classes whose word is in `clashes`."""
    return np.where(np.isin(sig, clashes), X.mix(sig2 ^ X.mix(sig)), sig) if len(clashes) else sig


def signatures(df: DataFrame, text: str, id_column: str, words: int, digest: bool = False) -> DataFrame:
    """id, n (set size), sig, sig2 of each document, and its text's md5 if asked for."""

    def run(raw, offsets):
        _, _, size, sig, sig2 = shingle_sets(raw, offsets, words)
        return [size, sig.view(np.int64), sig2.view(np.int64)]

    whole = df[X.quoted(text)].cast("string")
    source = df.select(df[X.quoted(id_column)].alias("id"), *[F.md5(F.coalesce(whole, F.lit(""))).alias("digest")] * digest, whole.alias("text"))
    return X.map_texts(source, "text", [("n", "bigint"), ("sig", "bigint"), ("sig2", "bigint")], run)


def numbered(narrow: DataFrame, seen: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Documents with `sig` made unique to their class, and the first words that several classes have; `seen`: sig, sig2 of each class."""
    clashes = np.sort(np.array([r[0] for r in seen.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig").limit(MOST_CLASHES + 1).collect()], np.int64).view(np.uint64))
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many classes with one signature word")
    if not len(clashes):
        return narrow, clashes

    def run(batches):
        for batch in batches:
            words = (batch.column(c).to_numpy().view(np.uint64) for c in ("sig", "sig2"))
            yield batch.set_column(batch.schema.get_field_index("sig"), "sig", pa.array(class_numbers(*words, clashes).view(np.int64)))

    return settled(narrow.mapInArrow(run, narrow.schema)), clashes


_ENTRIES = "bucket int, hashes binary, owners binary, sigs binary, sizes binary"


def incidence(df: DataFrame, text: str, words: int, ranges: int, clashes: np.ndarray) -> DataFrame:
    """The incidence in hash ranges: of each chunk of texts and range, sorted shingles, their owners, the owners' signatures and sizes."""

    def blobs(parts):
        owner, key, sig, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.unique(sig, return_index=True)[1]  # copies within the chunk count once
        stands = np.zeros(len(sig), bool)
        stands[first] = True
        take = stands[owner]
        owner, key = owner[take], key[take]
        order = np.argsort(key, kind="stable")
        owner, key = owner[order], key[order]
        bucket = hash_range(key, ranges)
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
            held, local = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(bucket[a]), packed_sorted(key[a:b]), planes(local, 4), planes(sig[held], 8), planes(size[held], 4)))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "hashes", "owners", "sigs", "sizes"]
        )

    def run(batches):
        parts, held, docs = [], 0, 0
        for _, raw, offsets in X.slices(batches, "text"):
            owner, key, size, sig, sig2 = shingle_sets(raw, offsets, words)
            if len(key):
                parts.append((owner + docs, key, class_numbers(sig, sig2, clashes), size))
                held, docs = held + len(raw), docs + len(size)
            if held >= CHUNK_BYTES:
                yield blobs(parts)
                parts, held, docs = [], 0, 0
        if parts:
            yield blobs(parts)

    return df.select(df[X.quoted(text)].cast("string").alias("text")).mapInArrow(run, _ENTRIES)


def shared_shingles(entries: DataFrame, groups: int) -> DataFrame:
    """Of each hash range the shingles of two classes or more, dealt into groups of classes: signatures, sizes, counts, shingles, frequencies."""

    def run(table: pa.Table) -> pa.Table:
        X.release()
        keys, sigs, sizes = [], [], []
        for hashes, owners, of_sig, of_size in zip(*(table.column(c).to_pylist() for c in ("hashes", "owners", "sigs", "sizes")), strict=True):
            local = unplaned(owners, 4)
            keys.append(unpacked_sorted(hashes))
            sigs.append(unplaned(of_sig, 8)[local])
            sizes.append(unplaned(of_size, 4)[local].astype(np.uint32))
        key, sig, size = np.concatenate(keys), np.concatenate(sigs), np.concatenate(sizes)
        del keys, sigs, sizes
        order = np.argsort(key, kind="stable")
        key = key[order]
        twice = np.zeros(len(key), bool)
        twice[1:] = key[1:] == key[:-1]
        twice[:-1] |= twice[1:]
        key, order = key[twice], order[twice]
        sig, size = sig[order], size[order]
        order = np.lexsort((sig, key))
        key, sig, size = key[order], sig[order], size[order]
        new = np.append(True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))[: len(key)]
        key, sig, size = key[new], sig[new], size[new]
        run_of = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
        df = np.bincount(run_of)[run_of] if len(key) else np.zeros(0, np.int64)
        take = df > 1
        key, sig, size, df = key[take], sig[take], size[take], df[take]
        group = (sig % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((key, sig, group))
        key, sig, size, df, group = key[order], sig[order], size[order], df[order], group[order]
        start, rows = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)]), []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(group)], strict=True) if len(start) else ():
            held, first, count = np.unique(sig[a:b], return_index=True, return_counts=True)
            rows.append((int(group[a]), planes(held, 8), planes(size[a:b][first], 4), planes(count, 4), planes(key[a:b], 8), planes(df[a:b], 5)))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(_SHARED)})

    return entries.groupBy("bucket").applyInArrow(run, "grp int, sigs binary, sizes binary, counts binary, shingles binary, freqs binary")


_SHARED = [("grp", pa.int32()), *[(c, pa.binary()) for c in ("sigs", "sizes", "counts", "shingles", "freqs")]]


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Classes that may link: sig, n, their shared shingles rarest first, and the number of those that can decide a link."""

    def run(table: pa.Table) -> pa.Table:
        X.release()
        sigs, sizes, keys, dfs = [], [], [], []
        for of_sig, of_size, counts, shingles, freqs in zip(*(table.column(c).to_pylist() for c, _ in _SHARED[1:]), strict=True):
            count = unplaned(counts, 4).astype(np.int64)
            sigs.append(np.repeat(unplaned(of_sig, 8), count))
            sizes.append(np.repeat(unplaned(of_size, 4).astype(np.int64), count))
            keys.append(unplaned(shingles, 8))
            dfs.append(unplaned(freqs, 5))
        sig, size, key, df = (np.concatenate(x) for x in (sigs, sizes, keys, dfs))
        order = np.lexsort((key, df, sig))
        sig, size, key = sig[order], size[order], key[order]
        held, first, shared_n = np.unique(sig, return_index=True, return_counts=True)
        n = size[first]
        must = -(-percent * n // 100)
        deciding = shared_n - must + 1  # the rarest n - must + 1, less the n - shared_n that nobody else has
        rows = [
            (int(held[i].view(np.int64)), int(n[i]), int(deciding[i]), key[first[i] : first[i] + shared_n[i]].tobytes())
            for i in np.flatnonzero(deciding > 0)
        ]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("sig", pa.int64()), ("n", pa.int64()), ("deciding", pa.int64()), ("shingles", pa.binary())))})

    return shared.groupBy("grp").applyInArrow(run, "sig long, n long, deciding long, shingles binary")


def deciding_shingles(found: DataFrame) -> DataFrame:
    """(sig, key) of each candidate's deciding shingles."""

    def run(batches):
        for batch in batches:
            sig, count = batch.column("sig").to_numpy(), batch.column("deciding").to_numpy()
            keys = [np.frombuffer(x, np.uint64)[:k] for x, k in zip(batch.column("shingles").to_pylist(), count.tolist(), strict=True)]
            made = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig, count)), pa.array(made.view(np.int64))], ["sig", "key"])

    return found.select("sig", "deciding", "shingles").mapInArrow(run, "sig long, key long")


def forest(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest set of each one's link component, from rows of the sparse product of the sets' incidence with its transpose.

    A row is taken from outside the largest component, counted against the sets not yet taken, and then left out; shingles that only one component has left are dropped.
    """
    n = len(sets)
    part, waiting = np.arange(n), np.ones(n, bool)
    key = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.lexsort((owner, key))
    shared, taken, again = None, 0, 0
    while True:
        left = np.flatnonzero(waiting)
        largest = np.bincount(part[left], minlength=n).argmax()
        outside = left[part[left] != largest]
        if not len(outside):
            return part
        if taken == again:  # the incidence of what is left, by shingle and by set
            order = order[waiting[owner[order]]]
            column = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
            count = np.bincount(column)
            one = part[owner[order]] == np.repeat(part[owner[order]][np.cumsum(count) - count], count)
            live = np.bincount(column, ~one)[column] > 0
            order = order[live]
            column = np.cumsum(np.append(False, key[order][1:] != key[order][:-1])[: len(order)])
            who, length = owner[order], np.bincount(column)
            start = np.cumsum(length) - length
            mine = np.argsort(who, kind="stable")
            shared = column[mine]
            at = np.searchsorted(who[mine], np.arange(n + 1))
            again = 2 * again + 16
        x = outside[0]
        waiting[x] = False
        taken += 1
        columns = shared[at[x] : at[x + 1]]
        if not len(columns):
            continue
        some = length[columns]
        ends = np.cumsum(some)
        overlap = np.bincount(who[np.arange(ends[-1]) + np.repeat(start[columns] - (ends - some), some)], minlength=n)
        linked = np.flatnonzero(waiting & (part != part[x]) & ((100 + percent) * overlap >= percent * (sizes + sizes[x])))
        joined = np.unique(np.append(part[linked], part[x]))
        part[np.isin(part, joined)] = joined[0]


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): the spanning forest of the links in each block; rows of `blocks`: block columns, sig, n, shingles."""

    def run(table: pa.Table) -> pa.Table:
        sig, first = np.unique(table.column("sig").to_numpy(), return_index=True)
        size, blobs = table.column("n").to_numpy()[first], table.column("shingles").to_pylist()
        top = forest(size, [np.frombuffer(blobs[i], np.uint64) for i in first.tolist()], percent)
        child = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": pa.array(sig[child]), "b": pa.array(sig[top[child]])})

    return blocks.groupBy("home", "left", "right").applyInArrow(run, "a long, b long")


def _pooled(home, many, pools: int):
    """Blocks of up to TILE classes share tasks, larger ones have tasks of their own."""
    return F.when(many > TILE, F.col(home)).otherwise(F.pmod(F.xxhash64(home), F.lit(pools)))


def _pools(sizes: DataFrame) -> int:
    return max(1, -(-2 * (sizes.where(F.col("many") <= TILE).agg(F.sum("many")).first()[0] or 0) // TILE))


def head_links(starred: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links within the blocks of classes that have the same smallest head, each tile of a block with the head itself."""
    homes = settled(starred.groupBy("sig").agg(F.min("head").alias("home")))
    sizes = settled(homes.groupBy("home").agg(F.count(F.lit(1)).alias("many")))
    pools = _pools(sizes)
    tiles = F.greatest(F.lit(1), F.ceil(F.col("many") / TILE)).cast("long")
    place = lambda tile: [_pooled("home", F.col("many"), pools).alias("home"), F.when(F.col("many") > TILE, tile).otherwise(F.lit(-1)).cast("long").alias("left"), F.lit(-1).cast("long").alias("right")]
    members = join_skewed(homes, sizes, ["home"], "many", homes.count()).where("sig <> home").select("sig", *place(F.pmod(F.xxhash64("sig"), tiles)))
    shingles = found.select("sig", "n", "shingles")
    rows = members.join(shingles.hint("merge"), "sig")
    # Heads get their shingles once, then go to each of their tiles.
    with_head = sizes.join(shingles.withColumnRenamed("sig", "home").hint("merge"), "home").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    with_head = with_head.select(F.col("home").alias("sig"), *place(F.col("tile")), "n", "shingles")
    return settled(block_links(rows.unionByName(with_head), percent))


def open_links(starred: DataFrame, labels: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Links between the classes of those deciding shingles whose classes are not all in one component; None if there are no such shingles."""
    named = settled(starred.select("key", "sig").join(labels.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").select("key", "sig", F.coalesce("root", "sig").alias("root")))
    mixed = settled(named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("sig").alias("home"), F.count(F.lit(1)).alias("n")).where("least <> most"))
    if mixed.isEmpty():
        return None
    members = settled(join_skewed(named, mixed.select("key", "home", "n"), ["key"], "n", named.count()).select("home", "sig", "root").distinct())
    parts = members.groupBy("home", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = settled(parts.groupBy("home").agg(F.sum("c").alias("many"), F.max(F.struct("c", "root")).alias("top")).select("home", "many", F.col("top.c").alias("inside"), F.col("top.root").alias("giant")))
    pools = _pools(sizes)
    rows = join_skewed(members, sizes, ["home"], "many", members.count()).join(found.select("sig", "n", "shingles").hint("merge"), "sig")
    of = lambda count: F.ceil(count / TILE).cast("long")
    rows = rows.withColumns({"ins": of(F.col("inside")), "outs": of(F.col("many") - F.col("inside")), "own": F.pmod(F.xxhash64("sig"), F.lit(1 << 40))})
    rows = rows.withColumn("tile", F.when(F.col("root") == F.col("giant"), F.pmod("own", "ins")).otherwise(F.col("ins") + F.pmod("own", F.greatest("outs", F.lit(1)))))
    # Those of the largest component meet the others' tiles, the others meet all tiles.
    zero = F.lit(0).cast("long")
    others = F.when(F.col("many") <= TILE, F.array(zero)).otherwise(F.sequence(F.when(F.col("tile") < F.col("ins"), F.col("ins")).otherwise(zero), F.col("ins") + F.col("outs") - 1))
    rows = rows.withColumn("other", F.explode(others))
    large = F.col("many") > TILE
    dealt = rows.select(
        "sig", "n", "shingles", _pooled("home", F.col("many"), pools).alias("home"), F.when(large, F.least("tile", "other")).otherwise(-1).alias("left"), F.when(large, F.greatest("tile", "other")).otherwise(-1).alias("right")
    )
    return settled(block_links(dealt, percent))


def class_components(found: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that have links."""
    lists = settled(deciding_shingles(found))
    heads = settled(lists.groupBy("key").agg(F.min("sig").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    starred = settled(join_skewed(lists, heads, ["key"], "n", lists.count()).select("key", "sig", "head"))
    labels = settled(components(head_links(starred, found, percent)))
    more = open_links(starred, labels, found, percent)
    if more is None or more.isEmpty():
        return labels
    return settled(components(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))


def _linked(df: DataFrame, text: str, id_column: str, words: int, percent: int, digest: bool = False) -> DataFrame:
    """Of each document id, n, size (documents with its very set), root (its component, null without shingles), first_id (the smallest id in it), and digest if asked for."""
    narrow = settled(signatures(df, text, id_column, words, digest))
    by_set = lambda rows, *keys: rows.where("n > 0").groupBy(*keys).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"))
    classes = settled(by_set(narrow, "sig", "sig2"))
    narrow, clashes = numbered(narrow, classes)
    classes = settled(by_set(narrow, "sig")) if len(clashes) else classes.drop("sig2")
    none = narrow.where("n = 0").select("id", "n", F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("root"), F.col("id").alias("first_id"), *["digest"] * digest)
    count, documents, shingles = classes.agg(F.count(F.lit(1)), F.sum("size"), F.sum("n")).first()
    if not count:
        return none
    ranges = max(64, -(-shingles // RANGE_SHINGLES))
    groups = max(64, -(-count // 20_000))
    found = settled(candidates(shared_shingles(incidence(df, text, words, ranges, clashes), groups), percent))
    of_class = class_components(found, percent)
    named = settled(of_class.join(classes.select(F.col("sig").alias("node"), "first_id").hint("merge"), "node"))
    least = settled(named.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("many")))
    of_class = settled(join_skewed(named.select("node", "root"), least, ["root"], "many", named.count()).select(F.col("node").alias("sig"), "root", "least_id"))
    entries = settled(classes.join(of_class.hint("merge"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("first_id"), "size"))
    full = join_skewed(narrow.where("n > 0").drop("sig2"), entries, ["sig"], "size", documents)
    return full.select("id", "n", "size", "root", "first_id", *["digest"] * digest).unionByName(none)


def link_components(df: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: its id, n_shingles, component_id (the smallest id reachable by links), class_size (documents with its very set)."""
    found = _linked(df, text, id_column, words, percent)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"), F.col("size").alias("class_size"))


def keep_one_each(df: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its columns: that of the smallest id (nulls last), of several rows with that id the one whose text has the smallest md5. Rows without shingles all stay.

    Rows are told apart by id and text, so rows that share an id do not share their fate.
    """
    found = settled(_linked(df, text, id_column, words, percent, digest=True).where("root IS NOT NULL"))
    ident = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    best = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "digest"))
    chosen = found.groupBy("root").agg(best.alias("b")).select("b.id", "b.digest")
    times = found.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("__n")).select(ident(F.col("id")).alias("__id"), F.col("digest").alias("__digest"), "__n")
    stays = settled(times.join(chosen.select(ident(F.col("id")).alias("__id"), F.col("digest").alias("__digest")).hint("merge"), ["__id", "__digest"]))
    whole = F.coalesce(df[X.quoted(text)].cast("string"), F.lit(""))
    rows = df.select(F.struct(*[df[X.quoted(c)] for c in df.columns]).alias("row"), ident(df[X.quoted(id_column)]).alias("__id"), F.md5(whole).alias("__digest"), whole.rlike(r"[^\x20\x09-\x0D]").alias("__words"))
    kept = join_skewed(rows.where("__words"), stays, ["__id", "__digest"], "__n", found.count()).dropDuplicates(["__id", "__digest"])
    return kept.select("row.*").unionByName(rows.where("NOT __words").select("row.*"))

"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

Documents are sets of word shingles. Equal sets become one class before anything else, so thousands
of copies cost one row. Each class gets a SuperMinHash signature (Ertl, 2017), cut into bands; classes
that share a band form a bucket. A bucket is compared with its least member only (a star, not all
pairs), links are confirmed on the full sets, and union-find groups them. Then, in buckets of three or more
whose members lie in more than one group, every member outside the main group is compared with all members
of other groups, so that no link between candidates is missed: in blocks of full sets, of a bounded number and
size, that return no more than the links which connect groups. Buckets with the same members are compared once.

With 32 bands of 5 values, a pair of similarity 0.8 shares no band with a probability of 3e-6. Links follow
from the buckets alone: there is one path for buckets of all sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import fresh, only_ids, pieces, shared_table, text_column
from kinescribe.llm.hashing import U, gram_hashes, mix, word_hashes

BANDS, ROWS = 32, 5
#: Sets and shingles in a block of the comparison between groups, on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Bytes of text that are signed at a time.
PIECE = 1 << 20


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive documents, sorted by document and hash, and the documents'
    bounds. Letters A-Z count as a-z. A document of fewer than k words has its whole sequence as its one
    shingle; one without words has none."""
    words, start, _ = word_hashes(data, lower=True)
    n = len(at) - 1
    bound = np.searchsorted(start, at)
    count = np.diff(bound)
    grams = gram_hashes(words, k)
    doc = np.repeat(np.arange(n), count)
    inside = np.arange(len(grams)) + k <= bound[1:][doc[: len(grams)]]
    value, owner = grams[inside], doc[: len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = [gram_hashes(words[bound[i] : bound[i + 1]], int(count[i]))[0] for i in short]
        value, owner = np.concatenate((value, np.array(whole, U))), np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n + 1))


def superminhash(value: np.ndarray, bound: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets given by hashes and bounds.

    Each element takes the ranks 0, 1, 2, ... of a random permutation of the m places in turn and offers
    rank + uniform at each place; a place keeps the least offer. As ranks only rise, a document is done
    once all its places are below the next rank. The permutations are built as they are needed: a step
    looks up which earlier swaps moved the place it draws."""
    n = len(bound) - 1
    out = np.full(n * m, np.inf)
    element, doc = value, np.repeat(np.arange(n), np.diff(bound))
    drawn: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    for rank in range(m):
        if rank:
            open_ = (out.reshape(n, m).max(axis=1) >= rank)[doc]
            if not open_.all():
                element, doc = element[open_], doc[open_]
                drawn, moved = [x[open_] for x in drawn], [x[open_] for x in moved]
        if not len(element):
            break
        bits = mix(element ^ mix(np.array([2 * rank + 1], U))[0])
        offer = rank + (bits >> U(11)).astype(np.float64) * 2.0**-53
        place = rank + (mix(bits + U(rank + 1)) % U(m - rank)).astype(np.int64)
        here, there = np.full(len(place), rank, np.int64), place.copy()
        for k, q in zip(drawn, moved):
            here = np.where(k == rank, q, here)
            there = np.where(k == place, q, there)
        np.minimum.at(out, doc * m + there, offer)
        drawn.append(place)
        moved.append(here)
    return out.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it. Empty sets have no meaning here."""
    bits = sig.view(U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U) + U(1), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in pieces(batches, "__bytes", PIECE):
            value, bound = shingle_sets(data, at, k)
            keys = band_keys(superminhash(value, bound, bands * rows), bands, rows)
            sets = [_digest(value[a:b].tobytes()) for a, b in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(bound), pa.int64()), pa.array(sets, pa.binary()), _lists(keys.ravel(), bands)],
                names=["doc_id", "key", "n_shingles", "set_key", "keys"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in pieces(batches, "__bytes", PIECE):
            value, bound = shingle_sets(data, at, k)
            sets = [value[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sets, pa.binary())], names=["set_key", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for a, b in zip(part.column("members_a"), part.column("members_b")):
                    x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                    if len(x) > len(y):
                        x, y = y, x
                    spot = np.searchsorted(y, x)
                    both = int((y[np.minimum(spot, len(y) - 1)] == x).sum())
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links; a link from each node to the least of its tree."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    links = [(x, root(x)) for x in up if root(x) != x]
    for at in range(0, len(links), 1 << 16):
        a, b = zip(*links[at : at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b: binary): the least node that can be reached.

    Union-find runs inside each partition, which leaves at most one link a node and partition. Then
    every node takes the least label around it, and the label's own label, until none changes. Labels
    are written to the shared folder in each round; only a count comes to the driver."""
    forest = shared_table(links.select("a", "b").mapInArrow(_forest, "a binary, b binary"), "forest")
    if forest.isEmpty():
        return forest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = forest.union(forest.select("b", "a"))
    labels = shared_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = shared_table(low.join(hop, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if new.where("was != label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), text_column().alias("__bytes"))


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row a document: doc_id, key (a hash of its text), n_shingles, group and component_id (the least doc_id of
    the group). group is null for rows without shingles or doc_id."""
    signed = shared_table(_source(docs).mapInArrow(_sign(shingle, bands, rows), "doc_id long, key long, n_shingles long, set_key binary, keys array<long>"), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "key")).alias("at"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = shared_table(classes.select("set_key", F.col("at.doc_id").alias("id"), "at.key", "n", "keys"), "classes")

    # most buckets hold one class: only the keys are dealt out to find the others
    member = classes.select("set_key", "id", "n", F.explode("keys").alias("bucket"))
    several = shared_table(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), "buckets")
    member = shared_table(only_ids(member, several, "bucket").join(several, "bucket"), "members")
    many = member.groupBy("bucket").agg(F.min(F.struct("id", "set_key", "n")).alias("first"))
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    star = (
        member.join(many, "bucket")
        .where((F.col("set_key") != F.col("first.set_key")) & fits(F.col("n"), F.col("first.n")))
        .select(F.col("first.set_key").alias("a"), F.col("set_key").alias("b"))
        .distinct()
    )
    star = shared_table(star, "star")
    links = shared_table(_confirmed(docs, classes, star, shingle, percent), "links")
    group = components(links)

    placed = member.join(group, F.col("set_key") == F.col("node"), "left").select("bucket", "set_key", "n", F.coalesce("component", "set_key").alias("c"))
    late = _between_groups(docs, classes, placed, shingle, percent)
    # without any late link the groups stand
    if late is not None:
        late = shared_table(late, "links")
        if not late.isEmpty():
            group = components(links.union(late))

    by_class = classes.join(group, F.col("set_key") == F.col("node"), "left").select("set_key", "id", F.coalesce("component", "set_key").alias("group"))
    # written, so that both sides of the join come by plain exchanges: then the runtime can split a large group
    by_class = shared_table(by_class, "grouped")
    least = shared_table(by_class.groupBy("group").agg(F.min("id").alias("least")), "least")
    by_class = by_class.join(least, "group").select("set_key", "group", "least")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    out = signed.select("doc_id", "key", "n_shingles", own.alias("set_key")).join(by_class, "set_key", "left")
    return out.select("doc_id", "key", "n_shingles", "group", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links lead to, its own
    included), kept (doc_id is component_id). Two documents are linked if 100 * common shingles are at
    least percent * all their shingles.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Each row is judged
    by its own text: rows of one doc_id with different texts are not linked by that, and repeated rows get the
    same. A row without doc_id is its own component, with a null component_id, and is kept; it links nothing.
    Memory follows the longest text. Other columns of docs are not used.
    """
    out = _grouped(docs, shingle, percent, bands, rows).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates, with their columns: of each group the row with the least doc_id
    (of several texts with that id, the one with the least hash) stays, once. Rows that are repeated whole, in
    doc_id and text, stay once as well. Rows without doc_id all stay."""
    rows = _grouped(docs, shingle, percent, BANDS, ROWS).where("doc_id is not null")
    each = shared_table(rows.groupBy("doc_id", "key", "group").agg(F.count("*").alias("m")), "rows")
    first = shared_table(each.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first")), "first")
    judged = each.join(first, "group", "left").withColumn("stays", F.coalesce((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.key") == F.col("key")), F.lit(True)))
    judged = shared_table(judged.select("doc_id", "key", "m", "stays"), "judged")

    key, name = fresh(docs, "near_key"), fresh(docs, "near_id")
    keyed = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), name: F.col("doc_id").cast("long")})
    listed = lambda df: df.select(F.col("doc_id").alias(name), F.col("key").alias(key))
    several = judged.where("stays and m > 1")
    out = keyed.join(listed(judged.where("not stays or m > 1")), [name, key], "left_anti").select(*docs.columns)
    if several.isEmpty():
        return out
    # map tasks merge repeats before anything moves
    whole = F.struct(*[docs[c] for c in docs.columns])
    one = keyed.join(listed(several), [name, key], "left_semi").groupBy(name, key).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return out.unionByName(one.select("row.*"))


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(set_key, members) of the classes named by keys. Only their texts are read into the join."""
    wanted = shared_table(keys.distinct().join(classes.select("set_key", F.col("id").alias("doc_id"), "key"), "set_key"), "wanted")
    # repeated rows are merged as texts, in the one exchange that the join needs as well
    texts = only_ids(_source(docs), wanted.select("doc_id")).groupBy("doc_id", "key").agg(F.first("__bytes").alias("__bytes"))
    sets = texts.join(wanted, ["doc_id", "key"]).select("set_key", "__bytes").mapInArrow(_full_sets(shingle), "set_key binary, members binary")
    return shared_table(sets, "sets")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links among pairs (a written table), on full sets."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")), shingle)
    side = lambda x: sets.select(F.col("set_key").alias(x), F.col("members").alias("members_" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(_confirm(percent), "a binary, b binary")


def _between_groups(docs: DataFrame, classes: DataFrame, placed: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Links between groups, from members (bucket, set_key, n, c: group) of buckets that lie in several; None if there
    is no such bucket. In a bucket of two the star has compared the pair.

    A bucket's members outside its main group are dealt into blocks, those of the main group into others. Each two
    blocks of which one is outside the main group meet in a task's hands, one such meeting at a time."""
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    groups = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("set_key")).alias("who"), F.min("set_key").alias("head"))
    mixed = groups.groupBy("bucket").agg(F.max(F.struct("k", "c", "w")).alias("top"), F.count("*").alias("groups"), F.sum("k").alias("size"), F.sum("w").alias("w"), F.bit_xor("who").alias("who"), F.min("head").alias("head"))
    mixed = mixed.where("groups > 1 and size > 2").groupBy("who", "head", "size").agg(F.min(F.struct("bucket", "top", "w")).alias("b"))
    mixed = mixed.select("b.bucket", F.col("b.top.c").alias("main"), blocks(F.col("b.top.k"), F.col("b.top.w")).alias("mains"), blocks(F.col("size") - F.col("b.top.k"), F.col("b.w") - F.col("b.top.w")).alias("others"))
    doc = shared_table(placed.join(mixed, "bucket"), "placed")
    if doc.isEmpty():
        return None
    other = F.col("c") != F.col("main")
    own = F.pmod(F.xxhash64("set_key"), F.when(other, F.col("others")).otherwise(F.col("mains"))).cast("int")
    doc = doc.withColumn("block", F.when(other, own).otherwise(-1 - own))
    every = F.sequence(F.lit(0), F.col("others") - 1)
    meet = F.when(
        other,
        F.concat(
            F.transform(every, lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"))),
            F.transform(F.sequence(F.lit(1), F.col("mains")), lambda m: F.struct((-m).alias("x"), F.col("block").alias("y"))),
        ),
    ).otherwise(F.transform(every, lambda o: F.struct(F.col("block").alias("x"), o.alias("y"))))
    doc = doc.join(_sets(docs, classes, doc.select("set_key"), shingle), "set_key")
    task = doc.select("bucket", "set_key", "c", "block", "members", F.explode(meet).alias("at")).select("bucket", "at.x", "at.y", "set_key", "c", "block", "members")
    return task.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_compare(percent), "a binary, b binary")


def _compare(percent: int):
    """Rows in the order of meetings (bucket, x, y) to links between groups; common shingles are counted through one
    sorted list of the block x for each set of the block y."""

    def links(table: pa.Table, x: int, y: int) -> list[tuple[bytes, bytes]]:
        names, groups = table.column("set_key").to_pylist(), table.column("c").to_pylist()
        block = table.column("block").to_numpy()
        code: dict[bytes, int] = {}
        c = np.array([code.setdefault(g, len(code)) for g in groups])
        if len(code) < 2:
            return []
        sets = [np.frombuffer(m, U) for m in table.column("members").to_pylist()]
        near, far = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if not len(near) or not len(far):
            return []
        size = np.array([len(sets[j]) for j in near], np.int64)
        flat, owner = np.concatenate([sets[j] for j in near]), np.repeat(np.arange(len(near)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        up = list(range(len(code)))

        def root(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        out = []
        for i in far.tolist():
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            count = high - low
            at = np.repeat(low - (np.add.accumulate(count) - count), count) + np.arange(int(count.sum()))
            both = np.bincount(owner[at], minlength=len(near))
            for j in near[(100 * both >= percent * (size + len(sets[i]) - both)) & (c[near] != c[i])].tolist():
                p, q = root(int(c[i])), root(int(c[j]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((names[i], names[j]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            found = links(pa.Table.from_batches(held), key[1], key[2]) if held else []
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(n).to_numpy() for n in ("bucket", "x", "y")])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                now = tuple(at[:, a].tolist())
                if now != key:
                    yield from close()
                    held, key = [], now
                held.append(batch.slice(a, b - a))
        yield from close()

    return run

"""Exact Jaccard join on word shingles through parity sketches.

Two sets link when 100 * |A & B| >= 75 * |A | B|; then at most (|A| + |B|) / 7 shingles are in one of
them only. The join runs in these steps, none of which drops a link:

1. Copies: documents with equal shingle sets are one class, represented by its smallest id.
2. Keys: sizes fall into bands that double. In the band of the smaller set the shingles are hashed
   into k blocks, where k exceeds the band's largest difference, and each block's hashes are XORed.
   Every differing shingle spoils one block at most, so k minus the difference blocks agree, and
   unless all of those are empty, two linked sets share a key. A set with so many empty blocks
   that this isn't certain is *open*; two open sets meet through prefix keys instead (the first
   quarter of a set's shingles in hash order), so the guarantee is whole.
3. Stars: each shared key links its first set with the others. The pairs pass the sketch test
   (XOR of one bit for each shingle; the sketches' Hamming distance never exceeds the difference),
   then the exact one, and give a first set of components. They collapse groups of near copies.
4. Rest: only keys whose sets are still in different components are looked at again, and only the
   pairs across components. A set without enough such keys for any link leaves, the others drop
   their most frequent ones as far as a link would still show in the rest. Small groups list them; large ones are tested block by block on their
   sketches inside the task, so that a pair leaves it only if it passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytes_np import U64, WHITE, Substrings, bounds, mix, word_spans
from tessera.llm.common import discard, give_back, small_batches, stored, utf8_chunks
from tessera.llm.components import connected_components

WORDS = 5
#: Upper ends of the size bands.
BANDS = np.array([4 << i for i in range(40)], np.int64)
#: Blocks of each band: above a third of the largest size, with room for empty blocks.
BLOCKS = np.array([int(1.06 * (int(u) // 3 + 1)) + 3 for u in BANDS], np.int64)
#: Groups up to this size list their pairs; larger ones are tested in blocks of at most BLOCK_ROWS.
LIST_ROWS = 32
BLOCK_ROWS = 2048
#: Up to this many document ids (8 bytes each) are broadcast to pick the candidates' texts; more are joined.
BROADCAST_IDS = 1_000_000
#: A task sorts about this many keys at most.
TASK_KEYS = 4_000_000

_FACTORS = [U64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_NOT_WHITE = ~WHITE
_HASH_BYTES = 8


def shingle_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's 5-word shingles, one text after the other.

    Also where each text's run begins (n + 1 places). Words are lower-cased in A-Z. A text of one to
    four words has its whole sequence as the one shingle; one without words has none.
    """
    n = len(offsets) - 1
    starts, ends, text_of = word_spans(data, offsets, _NOT_WHITE)
    words = Substrings(data).hashes(starts, ends)
    m = max(len(words) - WORDS + 1, 0)
    rolled = np.zeros(m, U64)
    for k, factor in enumerate(_FACTORS):
        rolled += words[k : k + m] * factor
    whole = text_of[:m] == text_of[WORDS - 1 :] if m else np.zeros(0, bool)
    values, owner = mix(rolled[whole]), text_of[:m][whole]
    at = bounds(text_of, n)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < WORDS))
    if len(short):
        one = (at[short + 1] - at[short]).astype(U64)
        for k in range(WORDS - 1):
            more = at[short] + k < at[short + 1]
            one[more] = mix(one[more] * _FACTORS[0] + words[at[short[more]] + k])
        values, owner = np.concatenate([values, one]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    at = bounds(owner, n)
    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        values[first:last].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], bounds(owner[fresh], n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The same as one array for each text."""
    values, at = shingle_runs(data, offsets)
    return np.split(values, at[1:-1])


def digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set as two signed numbers; an empty set has that of no elements."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), 2), U64)
    if len(some):
        out[some, 0] = np.add.reduceat(mix(values), at[some])
        out[some, 1] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at[some])
    return mix(out + n[:, None].astype(U64)).view(np.int64)


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * common >= 75 * (a + b - common)


#: The lowest two bits of a key: whether its band is even or odd, or it is a prefix key.
KIND = 3
PREFIX_KEY = 2


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys under which each set meets every other set that it may link with, and whose they are.

    Also, for each set and kind of key, how many of that kind any linked set shares with it at least
    (1 if nothing more is known).
    """
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    spread = mix(values ^ U64(0x2545F4914F6CDD1D))
    need = np.ones((len(size), 3), np.int64)
    band = np.searchsorted(BANDS, size)
    is_open = np.zeros(len(size), bool)
    keys, owners = [], []

    def of_kind(hashes: np.ndarray, kind: np.ndarray, whose: np.ndarray) -> None:
        keys.append(hashes & ~U64(KIND) | kind.astype(U64))
        owners.append(whose)

    for below in (0, 1):
        level = np.maximum(band - below, 0)
        top = BANDS[level]
        # One or two shingles link with equal sets only.
        use = (size >= 3) & (band >= below) & ((below == 0) | (3 * size <= 4 * top))
        blocks = np.where(use, BLOCKS[level], 0)
        base = np.cumsum(blocks) - blocks
        mine = use[owner]
        own = owner[mine]
        slot = base[own] + ((spread[mine] >> U64(32)) * blocks[own].astype(U64) >> U64(32)).astype(np.int64)
        parity = np.zeros(int(blocks.sum()), U64)
        np.bitwise_xor.at(parity, slot, values[mine])
        filled = np.zeros(len(parity), bool)
        filled[slot] = True
        whose, place = np.repeat(np.arange(len(size)), blocks)[filled], np.flatnonzero(filled)
        number = (place - base[whose] + (level[whose] << 40)).astype(U64)
        of_kind(mix(parity[filled] + mix(number)), level[whose] & 1, whose)
        largest = top if below else 4 * size // 3
        sure = np.bincount(whose, minlength=len(size)) - (size + largest) // 7  # blocks less the empty ones less the spoilt ones
        rows = np.flatnonzero(use)
        need[rows, level[rows] & 1] = np.maximum(1, sure[rows])
        is_open |= use & (sure < 1)
    for k in np.flatnonzero(is_open).tolist():
        n = int(size[k])
        first = np.sort(spread[at[k] : at[k + 1]])[: n - -(-75 * n // 100) + 1]
        of_kind(mix(first ^ U64(0x6C62272E07BB0142)), np.full(len(first), PREFIX_KEY), np.full(len(first), k))
    return np.concatenate(keys), np.concatenate(owners), need


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch: each shingle flips one bit; two to four bits a shingle, a power of two of them."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    where = mix(shingles ^ U64(0x9E6C63D0876A3F6B)) & U64(bits - 1)
    flips = np.bincount(where.astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch (or rows of sketches) at a smaller power-of-two width: halves are XORed."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def possible(distance: np.ndarray, size_a: int, size_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, whose sketches are so far apart, may link: necessary, never wrong about a link."""
    return (7 * distance <= size_a + size_b) & (4 * np.minimum(size_a, size_b) >= 3 * np.maximum(size_a, size_b))


def may_link(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
    """The same for two sketches of any width."""
    width = min(len(a), len(b))
    distance = np.bitwise_count(folded(b, width) ^ folded(a, width)).sum(dtype=np.int64)
    return bool(possible(distance, size_a, size_b))


def _arrow(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    array = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([array(columns[k], t) for k, t in types.items()], names=list(types))


_LONG, _BINARY = pa.int64(), pa.binary()


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's digest and, once for each set in the task, the keys and how many of them a link needs."""
    types = {"doc_id": _LONG, "n_shingles": _LONG, "ent": _LONG, "ent2": _LONG, "need": pa.list_(_LONG), "keys": pa.list_(_LONG)}
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for a, b, data, offsets in utf8_chunks(batch.column(1)):
            values, at = shingle_runs(data, offsets)
            both, n = digests(values, at), np.diff(at)
            first = np.zeros(b - a, bool)
            for k, pair in enumerate(map(tuple, both.tolist())):
                if n[k] and pair not in seen:
                    seen.add(pair)
                    first[k] = True
            some = np.flatnonzero(first)
            keys, owners, need = set_keys(values[np.repeat(first, n)], np.concatenate([[0], np.cumsum(n[some])]))
            keys = keys[np.argsort(owners, kind="stable")].view(np.int64)
            counts = np.zeros(b - a, np.int64)
            counts[some] = np.bincount(owners, minlength=len(some))
            needs = np.ones((b - a, 3), np.int64)
            needs[some] = need
            lists = lambda flat, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, _LONG))
            columns = [batch.column(0)[a:b], n, both[:, 0], both[:, 1], lists(needs.ravel(), 3 * np.arange(1, b - a + 1)), lists(keys, np.cumsum(counts))]
            yield _arrow(dict(zip(types, columns)), types)
    give_back()


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"ent": _LONG, "rep": _LONG, "n": _LONG, "sketch": _BINARY, "shingles": pa.list_(_LONG)}
    for batch in batches:
        for a, b, data, offsets in utf8_chunks(batch.column(1), 1 << 19):
            values, at = shingle_runs(data, offsets)
            yield _arrow(
                {
                    "ent": digests(values, at)[:, 0],
                    "rep": batch.column(0)[a:b],
                    "n": np.diff(at),
                    "sketch": [sketch(s).tobytes() for s in np.split(values, at[1:-1])],
                    "shingles": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64), _LONG)),
                },
                types,
            )
    give_back()


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, ent) rows sorted by both: the distinct ones whose key has two ents or more.

    It streams: of a key of any size it holds one row.
    """
    types = {"key": _LONG, "ent": _LONG}
    held: tuple[int, int] | None = None  # the row before this batch
    alone = False  # whether it is the first of its key, which hasn't been given out yet
    for batch in batches:
        key, ent = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ent[1:] != ent[:-1])
        fresh[0] = held != (key[0], ent[0])
        key, ent = key[fresh], ent[fresh]
        if not len(key):
            continue
        starts = np.ones(len(key), bool)
        starts[1:] = key[1:] != key[:-1]
        starts[0] = held is None or held[0] != key[0]
        use = ~starts
        use[:-1] |= ~starts[1:]
        if alone and not starts[0]:
            yield _arrow({"key": [held[0]], "ent": [held[1]]}, types)
        if use.any():
            yield _arrow({"key": key[use], "ent": ent[use]}, types)
        held, alone = (key[-1], ent[-1]), not use[-1]
    give_back()


def _pairs_of_large(nearest_only: bool):
    """Pairs across components that pass the sketch test, of groups sorted by (key, i, j).

    A group is one block (i = j) or two blocks of a key's sets and holds 2 * BLOCK_ROWS rows or so.
    With ``nearest_only`` it gives for each two components in a group the pair whose sketches are
    nearest for its sizes.
    """
    types = {"a": _LONG, "b": _LONG}

    def flush(rows: list[tuple], given: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        ent = np.array([r[3] for r in rows])
        comp, size, chunk = (np.array([r[k] for r in rows]) for k in (4, 5, 6))
        width = min(len(r[7]) for r in rows) // _HASH_BYTES
        words = np.stack([folded(np.frombuffer(r[7], U64), width) for r in rows])
        two = rows[0][1] != rows[0][2]
        left, right, apart = [], [], []
        for k in range(len(rows) - 1):
            other = slice(k + 1, None)
            distance = np.bitwise_count(words[other] ^ words[k]).sum(axis=1, dtype=np.int64)
            ok = possible(distance, size[k], size[other]) & (comp[other] != comp[k])
            if two:
                ok &= chunk[other] != chunk[k]
            found = np.flatnonzero(ok)
            left.append(np.full(len(found), k))
            right.append(found + k + 1)
            apart.append(distance[found] / (size[k] + size[other][found]))
        a, b, apart = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
        if nearest_only and len(a):
            low, high = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
            order = np.lexsort((apart, high, low))
            a, b, low, high = a[order], b[order], low[order], high[order]
            first = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            a, b = a[first], b[first]
        pairs = set(zip(np.minimum(ent[a], ent[b]).tolist(), np.maximum(ent[a], ent[b]).tolist())) - given
        if len(given) > 1_000_000:  # only spares repeats; the pairs are made distinct later
            given.clear()
        given |= pairs
        if pairs:
            x, y = zip(*sorted(pairs))
            yield _arrow({"a": x, "b": y}, types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    yield from flush(rows, given)
                    rows = []
                rows.append(row)
        yield from flush(rows, given)
        give_back()

    return run


def _sketch_test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"a": _LONG, "b": _LONG}
    for batch in batches:
        a, b, n_a, n_b, sketch_a, sketch_b = (c.to_pylist() for c in batch.columns)
        use = [
            may_link(np.frombuffer(x, U64), n, np.frombuffer(y, U64), m) for n, m, x, y in zip(n_a, n_b, sketch_a, sketch_b)
        ]
        yield _arrow({"a": [x for x, u in zip(a, use) if u], "b": [x for x, u in zip(b, use) if u]}, types)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep_a, rep_b) of the linked ones among (a, b) pairs of sets."""
    side = lambda x, *more: sets.select(F.col("ent").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more])
    passed = (
        pairs.distinct()
        .join(side("a", "n", "sketch"), "a")
        .join(side("b", "n", "sketch"), "b")
        .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        .mapInArrow(_sketch_test, "a long, b long")
    )
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (
        passed.join(side("a", "rep", "n", "shingles"), "a")
        .join(side("b", "rep", "n", "shingles"), "b")
        .filter(linked(common, F.col("n_a"), F.col("n_b")))
        .select("rep_a", "rep_b")
    )


def _needed(rest: DataFrame, needs: DataFrame) -> DataFrame:
    """Of the (key, ent, kind, comp, size) rows those under which a set has to look for links.

    A set that shares fewer keys of a kind than any link of that kind needs has none there. Of the
    others, linked sets share ``least`` keys at least, so if each leaves out its least - 1 most frequent
    ones (one order for all), one shared key remains. ``size`` is counted anew.
    """
    own = Window.partitionBy("ent", "kind")  # at most as many rows as a set has blocks
    kept = (
        rest.join(needs, ["ent", "kind"])
        .withColumn("has", F.count("*").over(own))
        .withColumn("place", F.row_number().over(own.orderBy("size", "key")))
        .filter("place <= has - least + 1")
        .select("key", "ent", "comp")
    )
    return _across(kept)


def _across(rows: DataFrame) -> DataFrame:
    """The rows of keys whose sets are in two components or more, with the key's number of rows as ``size``."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return rows.join(sizes.filter("low < high").select("key", "size"), "key")


def _large_pairs(large: DataFrame, sets: DataFrame, parts: int, nearest_only: bool) -> DataFrame:
    """Candidate pairs (a, b) of large groups; groups above BLOCK_ROWS are dealt out as pairs of blocks."""
    whole = large.filter(F.col("size") <= BLOCK_ROWS).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "ent", "comp", F.lit(0).alias("chunk"))
    cut = (
        large.filter(F.col("size") > BLOCK_ROWS)
        .withColumn("chunks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("ent"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "ent", "comp", "chunk")
    )
    blocks = (
        whole.union(cut)
        .join(sets.groupBy("ent").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "ent")
        .select("key", "i", "j", "ent", "comp", "n", "chunk", "sketch")
    )
    return blocks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_pairs_of_large(nearest_only), "a long, b long")


def _first_of_keys(shared: DataFrame, kept: DataFrame) -> DataFrame:
    """The (key, ent, kind) rows whose (ent, kind) is in ``kept`` and whose key has another such row, with the key's first ent."""
    rows = shared.join(kept, ["ent", "kind"], "left_semi")
    firsts = rows.groupBy("key").agg(F.min("ent").alias("first"), F.max("ent").alias("last")).filter("first < last")
    return rows.join(firsts.select("key", "first"), "key").select("key", "ent", "kind", "first")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Shingles count as equal if their 64-bit hashes are; two different sets count as copies only if
    their 128-bit digests are equal. Apart from such collisions the result is exact.

    Defined cases: texts that are null, empty or without words have no shingles, link with nothing
    and are their own component; rows with equal ids are one document, whose links are those of all
    its rows; rows with a null id link with nothing and have a null component; an empty table gives
    no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):  # all but the last joins run in here
        return _groups(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))


def _groups(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    keyed = stored(rows.mapInArrow(_members, "doc_id long, n_shingles long, ent long, ent2 long, need array<long>, keys array<long>"), "keyed-sets")
    usable = "n_shingles > 0 and doc_id is not null"
    classes = stored(keyed.filter(usable).groupBy("ent", "ent2").agg(F.min("doc_id").alias("rep")), "classes")
    n_keys = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // TASK_KEYS))

    shared = stored(
        keyed.select(F.explode("keys").alias("key"), "ent")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "ent")
        .mapInArrow(_shared, "key long, ent long")
        .withColumn("kind", F.col("key").bitwiseAND(F.lit(KIND)).cast("int")),
        "shared-keys",
    )
    # A set that shares fewer keys of a kind than any link of that kind needs has no links there.
    needs = keyed.filter(F.size("keys") > 0).select("ent", F.posexplode("need").alias("kind", "least")).groupBy("ent", "kind").agg(F.min("least").alias("least"))
    counts = shared.groupBy("ent", "kind").agg(F.count("*").alias("has"))
    kept = stored(counts.join(needs, ["ent", "kind"]).filter("has >= least").select("ent", "kind"), "kept-sets")
    every, shared = shared, stored(_first_of_keys(shared, kept), "shared-keys")
    needs = stored(needs.join(shared.select("ent").distinct(), "ent", "left_semi"), "needs")
    members = stored(keyed.select("doc_id", "n_shingles", "ent", "ent2"), "sets")
    discard(every, kept, keyed)
    some = members.filter(usable)

    reps = classes.join(shared.select("ent").distinct(), "ent", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    reps = stored(reps, "candidates")
    few = reps.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(reps) if few else reps, "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(texts.mapInArrow(_candidates, "ent long, rep long, n long, sketch binary, shingles array<long>"), "candidate-sets")
    if sets.count() > sets.select("ent", "rep").distinct().count():  # rows that stand in the table twice
        twice, sets = sets, stored(sets.dropDuplicates(["ent", "rep"]), "candidate-sets")
        discard(twice)

    stars = shared.filter("ent <> first").select(F.least("ent", "first").alias("a"), F.greatest("ent", "first").alias("b"))
    links = stored(_verified(stars, sets), "links")

    def still_open(keys: DataFrame, found: DataFrame) -> DataFrame:
        """(key, ent, kind, comp, size) of the keys that may still show links across the components of ``found``."""
        now = connected_components(found).withColumnRenamed("node", "rep")
        known = sets.select("ent", "rep").join(now, "rep", "left").groupBy("ent").agg(F.min(F.coalesce("component", "rep")).alias("comp"))
        return stored(_across(keys.select("key", "ent", "kind").join(known, "ent").repartition(parts, "key")), "open-keys")

    open_ = still_open(shared, links)
    needed = stored(_needed(open_, needs), "needed-keys")
    large = needed.filter(F.col("size") > LIST_ROWS)
    if not large.isEmpty():
        # Groups of near copies may be a few components that many links join; one for each two is enough.
        before = (links, open_, needed)
        links = stored(links.union(_verified(_large_pairs(large, sets, parts, True), sets)), "links")
        open_ = still_open(open_, links)
        needed = stored(_needed(open_, needs), "needed-keys")
        discard(*before)
        large = needed.filter(F.col("size") > LIST_ROWS)

    small = needed.filter(F.col("size") <= LIST_ROWS)
    left = small.select("key", F.col("ent").alias("a"), F.col("comp").alias("comp_a"))
    right = small.select("key", F.col("ent").alias("b"), F.col("comp").alias("comp_b"))
    listed = left.join(right, "key").filter("a < b and comp_a <> comp_b").select("a", "b")
    tested = _large_pairs(large, sets, parts, False)
    more = _verified(listed.union(tested), sets)
    final = connected_components(links.union(more))
    discard(shared, needs, reps, sets, links, open_, needed)

    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "ent", "ent2", F.coalesce("component", "rep").alias("component_id")
    )
    alone = members.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(by_class, ["ent", "ent2"]).select("doc_id", "n_shingles", "component_id").union(alone)

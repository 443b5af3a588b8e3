"""Near-duplicate documents by min-max hashing, every link confirmed on the full shingle sets.

A document's set holds its distinct word shingles (A-Z lowered; a shorter text is one shingle, a text
without words has the empty set and is linked with nothing). Each of 64 permutations keeps both its
minimum and its maximum over the set, which gives 128 signature values for 64 hash evaluations.
Four values, from four different permutations, form the key of one of 32 bands: two sets with a
similarity of 0.8 miss each other in all bands with a probability below 1e-7.

Steps, each of which only moves what it needs:

1. Documents with equal sets are one class, named by its smallest id. Only classes go on.
2. Each class is compared with the smallest class of each of its buckets (a star, not all pairs).
   Pairs that differ in too many bits of short parity maps of their sets can't be linked and go no further: bits
   only cancel out, so no link is lost. The texts of the others are read again and their full sets compared.
3. Components of the confirmed links. A bucket is settled if it lies in one component, or if its
   star was all there is. In the other buckets, members of different components are compared by
   their full sets: bucket by bucket or, where that moves less, all members that open buckets join at
   once. Large groups are dealt into blocks of bounded size. Only links that join
   something come out, at most one fewer than a group has members.
4. Components again, over the links of both kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import U64, fresh, grams, list_array, mix, narrow, pieces, quoted, rows_by_ids, rows_with_ids, signed, words
from tidemark.llm.components import components
from tidemark.session import stage

PERMUTATIONS = 64
BANDS = 32
ROWS = 4
BLOCK = 512  # members of a block, on average
BLOCK_SHINGLES = 1_000_000
PARITY_BITS = 1 << 16  # of a map, at most

_RNG = np.random.default_rng(7)
_MULT = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(U64) | U64(1)
_XOR = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(U64)
# A band takes two minima, and two maxima of other permutations: those are rolled by half the bands.
_PLACES = np.arange(PERMUTATIONS)
_ORDER = np.concatenate([_PLACES, PERMUTATIONS + np.roll(_PLACES, BANDS // 2)]).reshape(ROWS, BANDS).T


def shingle_sets(
    body: np.ndarray, begins: np.ndarray, size: int
) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a run."""
    h, _, _, first = words(body, begins)
    for lo, hi in zip(first, first[1:]):
        n = hi - lo
        yield np.unique(grams(h[lo:hi], min(size, n))) if n else np.zeros(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation over a set that isn't empty."""
    low = np.full(PERMUTATIONS, ~U64(0))
    high = np.zeros(PERMUTATIONS, U64)
    for at in range(0, len(s), 1024):
        seen = (s[at : at + 1024] ^ _XOR[:, None]) * _MULT[:, None]
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return np.concatenate([low, high])


def parity_map(s: np.ndarray) -> bytes:
    """Of each place, the low bits of a hash, whether the set has an odd number of members there.

    The number of places is a power of two, at least twice the size of the set up to `PARITY_BITS`.
    """
    places = min(max(64, 1 << int(2 * len(s) - 1).bit_length()), PARITY_BITS)
    odd = np.bincount((s & U64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At least so many members are in one of two sets only, by their parity maps: the longer is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    most = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(m.reshape(-1, most), axis=0) for m in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    picked = signatures[:, _ORDER]
    key = np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key ^ picked[:, :, j]) * U64(3)
    return mix(key)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, h1, h2, keys, parity): set size, 128-bit hash of the set, band keys, parity map.

    `keys` and `parity` are empty for an empty set.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                rows = hi - lo
                n = np.zeros(rows, np.int64)
                h = np.zeros((rows, 2), U64)
                signs = np.zeros((rows, 2 * PERMUTATIONS), U64)
                parity = [b""] * rows
                for i, s in enumerate(shingle_sets(body, begins, size)):
                    if len(s):
                        n[i] = len(s)
                        h[i] = s.sum(dtype=U64), (mix(s * U64(5))).sum(dtype=U64)
                        signs[i] = signature(s)
                        parity[i] = parity_map(s)
                full = n > 0
                keys = _band_keys(signs[full])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows),
                        pa.array(n),
                        pa.array(signed(h[:, 0].copy())),
                        pa.array(signed(h[:, 1].copy())),
                        list_array(signed(keys.ravel()), full * BANDS, pa.int64()),
                        pa.array(parity, pa.binary()),
                    ],
                    names=["id", "n", "h1", "h2", "keys", "parity"],
                )

    schema = T.StructType(
        [
            T.StructField("id", kind),
            *T.StructType.fromDDL("n long, h1 long, h2 long, keys array<long>, parity binary"),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def possible(pairs: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those that can't be linked, judged by set sizes and parity maps.

    With a difference of d, the union of sets of x and y members has (x + y + d) / 2 and the intersection
    (x + y - d) / 2. Where an id has several rows, any two of them keep a pair.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # Only the maps that are asked for are moved.
    held = rows_with_ids(sk.where("n > 0").select("id", "n", "parity"), ends).distinct()
    sides = [held.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            maps = zip(batch.column(4), batch.column(5))
            d = np.array([least_difference(x.as_py(), y.as_py()) for x, y in maps], np.int64)
            yield batch.select([0, 1]).filter(pa.array(100 * (size - d) >= percent * (size + d)))

    kind = pairs.schema["a"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return both.mapInArrow(run, out).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= percent * union.

    `texts` (id, text) is shuffled once for both sides.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    held = rows_with_ids(texts, ends.distinct())
    with_b = pairs.join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = with_b.join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            left = _cursor(batch.column(2), size)
            right = _cursor(batch.column(3), size)
            for i, (x, y) in enumerate(zip(left, right)):
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = same > 0 and 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select([0, 1]).filter(pa.array(linked))

    kind = pairs.schema["a"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, out)


def _cursor(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, body, begins in pieces(column):
        yield from shingle_sets(body, begins, size)


def full_sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents in `ids`, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                sets = [x.tobytes() for x in shingle_sets(body, begins, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["id", "set"]
                )

    schema = T.StructType([texts.schema["id"], T.StructField("set", T.BinaryType())])
    # A row without words may share its id with one that has some.
    return rows_with_ids(texts, ids).mapInArrow(run, schema).where(F.length("set") > 0)


def _linked(sets: list[np.ndarray], group: np.ndarray, block: np.ndarray, percent: int) -> list[tuple]:
    """Links that join different groups, found by comparing the sets of each two members.

    Members of one group are not compared, nor are those that a link has joined meanwhile, nor, where there
    are two blocks, those of the same block.
    """
    universe, place = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    here = np.zeros(len(universe), np.int32)
    two = block.min() != block.max()
    group = group.copy()
    found = []
    for x in range(len(sets)):
        other = group != group[x]
        if two:
            other &= block != block[x]
        # A set can't be that like one of a very different size.
        other &= 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        other[: x + 1] = False
        if not other.any():
            continue
        lo = int(np.argmax(other))
        here[place[begins[x] : begins[x + 1]]] = 1
        same = np.add.reduceat(here[place[begins[lo] :]], begins[lo:-1] - begins[lo])
        here[place[begins[x] : begins[x + 1]]] = 0
        like = 100 * same >= percent * (sizes[lo:] + sizes[x] - same)
        for y in np.flatnonzero(like & other[lo:]) + lo:
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                found.append((x, int(y)))
    return found


def _cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a group that are in different components.

    `members` has key, blocks, id, component. A group is dealt into its number of blocks by a hash of the id,
    and every two blocks are compared in a task of their own, so no task gets more than two.
    """
    kind = members.schema["id"].dataType
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = members.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component"
    )

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_pylist()
        held = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        # Components may be of any kind, structs too.
        number: dict[str, int] = {}
        group = np.array([number.setdefault(repr(c), len(number)) for c in table["component"].to_pylist()])
        found = _linked(held, group, table["own"].to_numpy(), percent) if len(ids) > 1 else []
        id_type = table.schema.field("id").type
        a = pa.array([ids[x] for x, _ in found], id_type)
        b = pa.array([ids[y] for _, y in found], id_type)
        return pa.table({"a": a, "b": b})

    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return dealt.join(sets.hint("merge"), "id").groupBy("key", "i", "j").applyInArrow(run, out)


def _groups_to_compare(unsettled: DataFrame) -> DataFrame:
    """(key, blocks, id, component): groups in which every two members of a bucket meet.

    `unsettled` has key, id, component, size. A family is what buckets join. It is one group, unless
    its buckets are so much smaller that comparing bucket by bucket moves less.
    """
    first = unsettled.groupBy("key").agg(
        F.min("id").alias("a"), _blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"), F.count(F.lit(1)).alias("n")
    )
    first = stage(first, "open-buckets")
    family = components(unsettled.join(first, "key").select("a", F.col("id").alias("b")))
    family = family.withColumnRenamed("component", "family")
    people = unsettled.select("id", "component", "size").distinct().join(family, "id")
    people = stage(people, "families")
    cost = people.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), _blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks")
    )
    apart = first.join(family.withColumnRenamed("id", "a"), "a").groupBy("family").agg(
        F.sum(F.col("n") * F.col("blocks")).alias("apart")
    )
    cost = stage(cost.join(apart, "family"), "families")
    whole = F.col("n") * F.col("blocks") <= F.col("apart")
    together = people.join(cost.where(whole).select("family", "blocks"), "family").select(
        F.col("family").cast("string").alias("key"), "blocks", "id", "component"
    )
    small = people.join(cost.where(~whole).select("family"), "family").select("id")
    split = unsettled.join(small, "id").join(first.select("key", "blocks"), "key").select(
        F.concat(F.lit("bucket "), F.col("key")).alias("key"), "blocks", "id", "component"
    )
    return together.unionByName(split)


def _blocks(members, size):
    return F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their distinct
    `shingle`-word shingles. `component_id` is the smallest id reachable over links, the document's own
    included; `kept` says that it is the document's own.

    NULL and empty texts have an empty set and stand alone. Rows that share an id are one document in
    the graph and each get a row of the result. Rows without an id are linked with nothing: their
    component is NULL and they are kept. An empty table gives an empty result.
    """
    sk = stage(sketches(docs, id_col, text_col, shingle), "sketches")
    filled = sk.where("n > 0 and id is not null")
    classes = filled.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    # Written once: the class of each document is needed at the start and at the end.
    placed = stage(
        filled.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep").distinct(),
        "classes",
    )
    # The sketch of a class is that of the document that names it.
    reps = placed.where("id = rep").select("id").distinct()
    bands = filled.select("id", "keys").join(reps, "id", "left_semi").select("id", F.explode("keys").alias("key"))
    # Moved once, for the buckets and for their members.
    bands = stage(bands, "bands").repartition("key")
    buckets = bands.groupBy("key").agg(
        F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")
    ).where("a <> z")
    member = stage(bands.join(buckets.select("key", "a", "n").hint("merge"), "key"), "members")
    stars = member.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = stage(possible(stage(stars, "stars"), sk, percent), "possible")

    texts = narrow(docs, id_col, text_col).toDF("id", "text")
    links = stage(confirm(stars, texts, shingle, percent), "links")
    # Ids that name several texts can name several classes.
    other_names = placed.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(other_names.join(reps.select(F.col("id").alias("a")), "a", "left_semi"))
    first = components(links)

    labelled = member.where("n > 2").join(first, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    open_keys = labelled.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi").select("key")
    sizes = filled.groupBy("id").agg(F.max("n").alias("size"))
    unsettled = stage(labelled.join(open_keys, "key", "left_semi").join(sizes, "id"), "unsettled")
    if not unsettled.isEmpty():
        sets = full_sets(texts, unsettled.select("id").distinct(), shingle)
        late = stage(_cross_links(_groups_to_compare(unsettled), sets, percent), "links")
        # What the new links join is found on the components so far.
        hung = first.select(F.col("id").alias("a"), F.col("component").alias("b"))
        first = components(hung.unionByName(late))

    named = placed.join(
        first.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left"
    ).groupBy("id").agg(F.min(F.coalesce("c", "rep")).alias("component_id"))
    left, right = sk.select("id", "n"), named.withColumnRenamed("id", "_id")
    joined = left.join(right, left["id"] == right["_id"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each group of linked texts, one with the smallest id, with all columns of `docs`.

    Rows are told apart by id and text: rows that share an id but not a text are linked by their texts only,
    so texts that are not alike all stay. Of rows that agree in both one stays. Rows without an id all stay.
    """
    row = fresh(docs, "row_of")
    columns = [F.col(quoted(c)) for c in docs.columns]
    text = F.xxhash64(F.col(quoted(text_col)))
    known = docs.where(docs[id_col].isNotNull())
    texts = known.groupBy(docs[id_col]).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi"))
    # Where no id has two texts, the id alone tells rows apart, and less is moved.
    alone = texts.where("_lo <> _hi").isEmpty()
    named = known.withColumn(row, docs[id_col] if alone else F.struct(docs[id_col].alias("id"), text.alias("text")))
    groups = near_duplicates(named.select(row, F.col(quoted(text_col))), row, text_col, shingle, percent)
    held = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    held = stage(held, "kept-rows")
    stays = F.col("kept") & (F.col("n") == 1)
    many = held.where("kept and n > 1").select("id")
    # Most texts stay where they are: those that few ids, of rows to keep or of others, can't mean.
    total, n_stay = held.agg(F.count(F.lit(1)), F.count_if(stays)).first()
    has = 2 * n_stay < total
    stay = rows_by_ids(named, held.where(stays if has else ~stays).select("id"), row, has).select(*columns)
    if not many.isEmpty():
        # Rows that agree in id and text: the least of them, found before the shuffle.
        cells = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).alias("cells")
        some = rows_with_ids(named.select(F.col(row).alias("id"), cells), many)
        order = F.struct(*[f"cells.c{k}" for k, (_, kind) in enumerate(docs.dtypes) if "map" not in kind])
        least = some.groupBy("id").agg(F.min_by("cells", order).alias("cells"))
        stay = stay.union(least.select(*[F.col(f"cells.c{k}") for k in range(len(columns))]).toDF(*docs.columns))
    return stay.union(docs.where(docs[id_col].isNull()))

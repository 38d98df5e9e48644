"""MinHash near-duplicates by an inverted join over signature coordinates.

Every distinct shingle set is posted under the (coordinate, value) pairs of its first POSTED
coordinates. Two sets of similarity 0.8 agree in about 38 of these 48 and in 102 of all 128; pairs
that agree in POSTED_MATCHES of the posted and MATCHES of all coordinates are wanted.

* Prefix: in one order of all postings, rare ones first, two sets that share POSTED_MATCHES
  postings share one among the first `size - POSTED_MATCHES + 1` of each. Postings held by one set
  only match nothing, so a set with fewer than POSTED_MATCHES shared ones leaves at once.
* Skip: the frequent postings, those of common passages, stand last and are never joined.
* Groups: a posting held by m sets is not expanded into m² pairs. Each posting compares its sets
  with one pivot, another one for every posting. Sets joined that way form components, and only
  pairs between different components of a posting are looked at again. Where a posting of more
  than SMALL sets still holds several components, its sets are dealt into blocks of bounded size and
  rows are made of pairs of blocks, not of sets: one task counts the coinciding coordinates of all
  pairs of two blocks, confirms those above the threshold and returns links that join components
  only, fewer than it has sets. What is left are pairs of small postings. No link between
  components is lost.
* Every link is confirmed on the full sets. Only texts of sets that have a candidate are shuffled
  for that, and only those of dropped documents to leave them out: a bitmap of the wanted keys goes
  to where the texts lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import SPACE, pieces, row_key, written
from loanspan.llm.components import components, stars
from loanspan.llm.shingles import MinHash, WordHashes, set_id, shingle_set, similar

COORDINATES = 128
#: At similarity 0.8 fewer matches than this have a chance of 8.7 in a million.
MATCHES = 82
#: Likewise for the posted coordinates, 3.3 in a million; either one misses a pair, at most 12 in a
#: million together.
POSTED = 48
POSTED_MATCHES = 25
#: Sets in a block, where there are more than DENSE pairs for each set.
BLOCK = 1000
DENSE = 8
#: Pairs or ids, 24 bytes each, that are broadcast at most to pick texts. Of more, a bitmap is.
BROADCAST_ROWS = 500_000
#: Bits of a bitmap for each key; one in so many other keys passes it too, and a join sorts it out.
KEY_BITS = 16
#: Bits of one value of bitmap_construct_agg.
BITMAP = 32_768
#: Sets of the largest posting whose pairs are laid out as rows.
SMALL = 16
#: Sets and shingles of a block of a larger posting, on average.
HOME_SETS = 500
HOME_SHINGLES = 500_000


def _signatures(n: int, coordinates: int):
    def run(batches):
        known, signature = WordHashes(), MinHash(coordinates)
        for batch in pieces(batches):
            ids, sizes, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, n, known)
                sizes.append(len(shingles))
                ids.append(set_id(shingles) if len(shingles) else None)
                signatures.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(signatures, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_shingles", "sid", "signature"],
            )

    return run


def _confirmed(n: int, percent: int):
    def run(batches):
        known = WordHashes()
        for batch in pieces(batches):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            keep = []
            seen: dict[int, np.ndarray] = {}
            for i in range(len(a)):
                sets = []
                for sid, text in ((a[i], text_a[i]), (b[i], text_b[i])):
                    if sid not in seen:
                        if len(seen) > 500:
                            seen.clear()
                        # Rows that repeat an id with another text are not the set's text.
                        found = shingle_set(text, n, known)
                        seen[sid] = found if len(found) and set_id(found) == sid else None
                    sets.append(seen[sid])
                    if sets[-1] is None:
                        del seen[sid]
                if sets[0] is not None and sets[1] is not None and similar(*sets, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())),
                 batch.column(1).take(pa.array(keep, pa.int64()))],
                names=["u", "v"],
            )

    return run


def _confirmed_block(n: int, percent: int):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        known, sets = WordHashes(), {}
        for sid, text in zip(texts["sid"].to_pylist(), texts["text"].to_pylist(), strict=True):
            found = shingle_set(text, n, known)
            if len(found) and set_id(found) == sid:
                sets[sid] = found
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        keep = [
            i
            for i in range(len(a))
            if a[i] in sets and b[i] in sets and similar(sets[a[i]], sets[b[i]], percent)
        ]
        return pa.table({"u": [a[i] for i in keep], "v": [b[i] for i in keep]}, _LINKS)

    return run


class _Block:
    """Sets of two blocks, one of which may be missing, and links between their components."""

    def __init__(self, rows: list[tuple], n: int, known: WordHashes, sign: MinHash):
        self.sid, self.side, roots, signatures, self.sets = [], [], [], [], []
        seen = set()
        for sid, side, root, text in rows:
            if sid in seen:
                continue
            found = shingle_set(text, n, known)
            # Rows that repeat an id with another text are not the set's text.
            if len(found) and set_id(found) == sid:
                seen.add(sid)
                self.sid.append(sid)
                self.side.append(side)
                roots.append(root)
                signatures.append(sign(found))
                self.sets.append(found)
        self.label = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
        self.size = np.array([len(x) for x in self.sets], np.int64)
        self.signature = np.array(signatures, np.int32).reshape(len(self.sid), -1)

    def wanted(self, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and the matrix of pairs that may be links by size and signature."""
        side = np.array(self.side, np.int8)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        equal = np.zeros((len(a), len(b)), np.uint16)
        for c in range(self.signature.shape[1]):
            equal += self.signature[a, c][:, None] == self.signature[b, c][None, :]
        small = np.minimum(self.size[a][:, None], self.size[b][None, :])
        large = np.maximum(self.size[a][:, None], self.size[b][None, :])
        wanted = (equal >= matches) & (100 * small >= percent * large)
        return a, b, np.triu(wanted, 1) if same else wanted

    def links(self, percent: int, matches: int) -> list[tuple[int, int]]:
        """A link for every two components that the confirmed pairs join, and no more."""
        if len(self.sid) < 2:
            return []
        rows, columns, wanted = self.wanted(percent, matches)
        # Shingles as small numbers, so that a set is marked in one array and others are counted in it.
        numbers = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        ends = np.cumsum(self.size)
        numbered = [numbers[e - n : e] for e, n in zip(ends, self.size, strict=True)]
        marked = np.zeros(len(numbers), np.int64)
        found = []
        for a, mask in zip(rows, wanted, strict=True):
            others = columns[mask]
            others = others[self.label[others] != self.label[a]]
            if not len(others):
                continue
            marked[numbered[a]] = 1
            starts = np.cumsum(self.size[others]) - self.size[others]
            common = np.add.reduceat(marked[np.concatenate([numbered[o] for o in others])], starts)
            marked[numbered[a]] = 0
            linked = others[100 * common >= percent * (self.size[a] + self.size[others] - common)]
            joined, first = np.unique(self.label[linked], return_index=True)
            found += [(self.sid[a], self.sid[o]) for o in linked[first]]
            self.label[np.isin(self.label, joined)] = self.label[a]
        return found


def _forest(n: int, percent: int, coordinates: int, matches: int):
    """Links of each pair of blocks; rows come sorted by `pair`."""

    def run(batches):
        known, sign, rows, pair = WordHashes(), MinHash(coordinates), [], None

        def done():
            links = _Block(rows, n, known, sign).links(percent, matches)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"]
            )

        for batch in pieces(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != pair and rows:
                    yield done()
                pair = row[0]
                rows.append(row[1:])
        if rows:
            yield done()

    return run


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class _Search:
    def __init__(self, docs: DataFrame, n: int, percent: int, coordinates: int, matches: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.coordinates, self.matches = coordinates, matches
        self.rows = written(
            docs.mapInArrow(
                _signatures(n, coordinates),
                "doc_id bigint, n_shingles bigint, sid bigint, signature array<int>",
            )
        )
        self.sets = written(
            self.rows.filter("doc_id IS NOT NULL AND sid IS NOT NULL")
            .groupBy("sid")
            .agg(
                F.min("doc_id").alias("label"),
                F.first("n_shingles").alias("n_shingles"),
                F.first("signature").alias("signature"),
            )
        )

    def postings(self) -> DataFrame:
        """(key, sid) of the prefix of each set that can have a partner."""
        posted = self.sets.select(
            "sid", F.posexplode(F.slice("signature", 1, POSTED)).alias("place", "value")
        ).select(
            "sid",
            F.shiftleft(F.col("place").cast("bigint"), 32)
            .bitwiseOR(F.col("value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
            .alias("key"),
        )
        shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        ordered = (
            posted.join(shared, "key")
            .groupBy("sid")
            .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
            .filter(F.size("keys") >= POSTED_MATCHES)
        )
        return written(
            ordered.select(
                "sid",
                F.explode(F.slice("keys", 1, F.size("keys") - (POSTED_MATCHES - 1))).alias("e"),
            ).select("sid", F.col("e.key").alias("key"))
        )

    def matching(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and signatures allow the similarity."""
        side = lambda x: self.sets.select(
            F.col("sid").alias(x),
            F.col("n_shingles").alias(f"n_{x}"),
            F.col("signature").alias(f"s_{x}"),
        )
        equal = F.size(
            F.filter(
                F.zip_with("s_a", "s_b", lambda x, y: x == y),
                lambda same: same,
            )
        )
        return (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
            .filter(equal >= self.matches)
            .select("a", "b")
        )

    def links(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v) among the pairs, confirmed on the full sets.

        Each pair goes to the text of its first set and then to that of its second set.
        """
        labels = self.sets.select("sid", "label")
        pairs = written(
            pairs.join(labels.withColumnRenamed("sid", "a"), "a").select("a", "b", "label")
        )
        second = written(
            pairs.select(F.col("b").alias("sid")).distinct().join(labels, "sid")
        )
        if pairs.count() > DENSE * second.count():
            return self._links_by_block(pairs)
        left = self.texts(pairs).select("a", "b", F.col("text").alias("text_a"))
        right = self.texts(second).select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
        return written(
            left.join(right, "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(_confirmed(self.n, self.percent), "u bigint, v bigint")
        )

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Rows of `wanted`, which is written, with the texts of the documents of their `label`."""
        docs = self.docs
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        else:
            labels = wanted.select(F.col("label").alias("key")).distinct()
            docs = _listed(docs, "doc_id", labels).filter("listed").drop("listed")
        return docs.join(wanted, F.col("doc_id") == F.col("label"))

    def _links_by_block(self, pairs: DataFrame) -> DataFrame:
        """Links among many pairs of few sets: sets fall into blocks, each pair of blocks is one
        group, and a text goes once to each group that needs it instead of to each of its pairs."""
        sets = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))
        blocks = -(-sets.distinct().count() // BLOCK)
        placed = written(
            pairs.select(
                "a",
                "b",
                F.pmod("a", F.lit(blocks)).alias("pa"),
                F.pmod("b", F.lit(blocks)).alias("pb"),
            )
        )
        needed = written(
            placed.select(F.col("a").alias("sid"), "pa", "pb")
            .union(placed.select(F.col("b").alias("sid"), "pa", "pb"))
            .distinct()
            .join(self.sets.select("sid", "label"), "sid")
        )
        texts = self.texts(needed).select("pa", "pb", "sid", "text")
        return written(
            placed.groupBy("pa", "pb")
            .cogroup(texts.groupBy("pa", "pb"))
            .applyInArrow(_confirmed_block(self.n, self.percent), "u bigint, v bigint")
        )

    def homes(self, rooted: DataFrame, wide: DataFrame) -> DataFrame:
        """(sid, root, home, block, keys): sets of wide postings, dealt into blocks.

        A posting belongs to the widest posting that one of its sets is also in, and a set to the
        widest of those: near copies of one text end up in one home. A home is cut into as many
        blocks as its number of sets and of shingles asks for, by a hash of the set.
        """
        best = lambda c: F.max(c).alias("best")
        members = rooted.join(wide.select("key", "held"), "key")
        sets = (
            members.groupBy("sid", "root")
            .agg(best(F.struct("held", "key")), F.collect_list("key").alias("keys"))
            .join(self.sets.select("sid", "n_shingles"), "sid")
        )
        sets = written(sets)
        reached = sets.select(F.explode("keys").alias("key"), "best").groupBy("key").agg(best("best"))
        widest = (
            sets.select("sid", F.explode("keys").alias("key"))
            .join(reached, "key")
            .groupBy("sid")
            .agg(F.max("best").alias("widest"))
        )
        home = written(
            sets.join(widest, "sid").select("sid", "root", "n_shingles", "keys", F.col("widest.key").alias("home"))
        )
        counts = home.groupBy("home").agg(
            F.ceil(
                F.greatest(F.count("*") / HOME_SETS, F.sum("n_shingles") / HOME_SHINGLES)
            ).alias("blocks")
        )
        place = F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks"))
        return written(
            home.join(counts, "home").select(
                "sid", "root", "home", F.xxhash64("home", place).alias("block"), "keys"
            )
        )

    def links_in_blocks(self, homes: DataFrame) -> DataFrame:
        """Links that join components of wide postings.

        Every two sets that share a wide posting lie in two blocks that share it, or in one. Two
        blocks of one and the same component are not compared.
        """
        blocks = homes.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        held = homes.select("block", F.explode("keys").alias("key")).distinct().join(blocks, "block")
        side = lambda x: held.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high")])
        several = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
        pairs = (
            side("a")
            .join(side("b"), "key")
            .filter((F.col("block_a") <= F.col("block_b")) & several)
            .select(F.col("block_a").alias("first"), F.col("block_b").alias("second"))
            .distinct()
            .withColumn("pair", F.xxhash64("first", "second"))
        )
        sides = written(
            pairs.select("pair", F.col("first").alias("block"), F.lit(0).alias("side")).union(
                pairs.filter("first < second").select("pair", "second", F.lit(1))
            )
        )
        needed = written(
            homes.select("sid", "root", "block")
            .join(sides, "block")
            .join(self.sets.select("sid", "label"), "sid")
            .select("label", "pair", "sid", "side", "root")
        )
        return written(
            self.texts(needed)
            .select("pair", "sid", "side", "root", "text")
            .repartition("pair")
            .sortWithinPartitions("pair")
            .mapInArrow(
                _forest(self.n, self.percent, self.coordinates, self.matches), "u bigint, v bigint"
            )
        )


def _listed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """`df` with `listed`: true where the bigint `key` is one of `keys`, and seldom elsewhere.

    `keys` has distinct values in its one column `key`. They are marked in bitmaps of KEY_BITS bits
    a key, which are broadcast; no row of `df` is shuffled.
    """
    keys = written(keys)
    blocks = max(1, -(-keys.count() * KEY_BITS // BITMAP))
    place = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(blocks * BITMAP).cast("bigint"))
    block = F.shiftright("place", 15)
    bits = (
        keys.select(place.alias("place"))
        .select(block.alias("block"), F.col("place").bitwiseAND(F.lit(BITMAP - 1)).alias("bit"))
        .repartition("block")
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    byte = F.substring("bits", F.shiftright("place", 3).bitwiseAND(F.lit(BITMAP // 8 - 1)).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.getbit(value, F.col("place").bitwiseAND(F.lit(7)).cast("int"))
    return (
        df.withColumn("key", F.col(key))
        .withColumn("place", place)
        .withColumn("block", block)
        .join(F.broadcast(bits), "block", "left")
        .select(*df.columns, F.coalesce(bit == 1, F.lit(False)).alias("listed"))
    )


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """`rows` whose `row` is not in `dropped`, which is written and has no other column.

    Few dropped keys are broadcast. Of more, a bitmap tells most other rows, which stay where they
    are; dropped rows and the few that it can't tell from them are shuffled.
    """
    if dropped.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dropped), "row", "left_anti")
    listed = _listed(rows, "row", dropped.select(F.col("row").alias("key")))
    told = listed.filter("NOT listed")
    untold = listed.filter("listed").join(dropped, "row", "left_anti")
    return told.drop("listed").unionByName(untold.drop("listed"))


def _pivoted(members: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each set and its posting's pivot, with the number of such postings.

    The pivot is the least id after xor with a value of the posting, so each posting has another.
    """
    mask = F.xxhash64("key", F.lit(seed))
    pivots = members.groupBy("key").agg(
        F.min(F.col("sid").bitwiseXOR(mask)).alias("least"), F.count("*").alias("held")
    )
    pivots = pivots.filter("held > 1").select("key", F.col("least").bitwiseXOR(mask).alias("b"))
    return (
        members.join(pivots, "key")
        .filter("sid <> b")
        .groupBy(F.col("sid").alias("a"), "b")
        .agg(F.count("*").alias("common"))
    )


def similar_groups(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents whose sets of `n`-word shingles (words between white space, A-Z in lower case) have
    a Jaccard similarity of `percent` or more are linked; component_id is the smallest doc_id that
    links reach. A text with fewer words is one shingle. Null or empty texts have no shingles and
    are linked with nothing, as is a row without doc_id: its component_id is null and it is kept.
    Rows that repeat a doc_id are judged one by one. Sets are told apart by a 64-bit digest.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    search = _Search(docs, n, percent, coordinates, matches)
    postings = search.postings()

    # Each set with the pivot it meets most often, least id first.
    best = (
        _pivoted(postings, 0)
        .groupBy("a")
        .agg(F.max(F.struct("common", F.col("b").alias("b"))).alias("m"))
        .select("a", F.col("m.b").alias("b"))
    )
    checked = written(search.matching(best))
    # Links found later are added to the stars of the components so far.
    roots = components(search.links(checked))
    rooted = written(_rooted(postings, roots))
    wide = written(_unresolved(rooted).filter(F.col("held") > SMALL))
    homes = None
    if not wide.isEmpty():
        homes = search.homes(rooted, wide)
        roots = components(stars(roots).union(search.links_in_blocks(homes)))
        rooted = written(_rooted(postings, roots))
    narrow = _unresolved(rooted).filter(F.col("held") <= SMALL)
    pairs = _between(search, rooted, narrow, homes).join(checked, ["a", "b"], "left_anti")
    roots = components(stars(roots).union(search.links(written(search.matching(pairs)))))
    found = roots.withColumnRenamed("node", "sid")
    labelled = search.sets.select("sid", "label").join(found, "sid", "left")
    least = (
        labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("label").alias("least"))
    )
    by_set = labelled.join(least, "root", "left").select(
        "sid", F.coalesce("least", "label").alias("component_id")
    )
    return (
        search.rows.drop("signature")
        .join(by_set, "sid", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("sid").isNull(), F.col("doc_id"))
            .when(F.col("doc_id").isNotNull(), F.col("component_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _rooted(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, sid, root): postings with the component of each set."""
    return postings.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", F.coalesce("root", "sid").alias("root")
    )


def _unresolved(rooted: DataFrame) -> DataFrame:
    """(key, held, pairs): postings that hold sets of several components, with the number of
    sets and of pairs between components.

    Near copies share many postings. Of those that hold the same sets, told by two 64-bit sums of
    the ids' hashes, one stands for all.
    """
    squares = F.sum(F.col("n") * F.col("n"))
    return (
        rooted.groupBy("key", "root")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("x"),
            F.bit_xor(F.xxhash64("sid", F.lit(2))).alias("y"),
        )
        .groupBy("key")
        .agg(
            F.sum("n").alias("held"),
            F.count("*").alias("roots"),
            ((F.sum("n") * F.sum("n") - squares) / 2).alias("pairs"),
            F.bit_xor("x").alias("x"),
            F.bit_xor("y").alias("y"),
        )
        .filter("roots > 1")
        .groupBy("held", "pairs", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key", "held", "pairs")
    )


def _between(
    search: _Search, rooted: DataFrame, keys: DataFrame, homes: DataFrame | None
) -> DataFrame:
    """Pairs of sets of one posting that are in different components and near enough in size.

    Sets of one home have been compared with each other.
    """
    sizes = search.sets.select("sid", F.col("n_shingles").alias("n"))
    members = rooted.join(keys.select("key"), "key").join(sizes, "sid")
    if homes is None:
        members = members.withColumn("home", F.lit(None).cast("bigint"))
    else:
        members = members.join(homes.select("sid", "home"), "sid", "left")
    side = lambda x: members.select(
        "key", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "root", "n", "home")]
    )
    near = 100 * F.least("n_a", "n_b") >= search.percent * F.greatest("n_a", "n_b")
    apart = F.coalesce(F.col("home_a") != F.col("home_b"), F.lit(True))
    return (
        side("a")
        .join(side("b"), "key")
        .filter((F.col("root_a") < F.col("root_b")) & near & apart)
        .select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
        .distinct()
    )


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group: that of the smallest doc_id, one without id last.

    A document is a doc_id and a text, each of which may be null: rows of one id with different
    texts are judged one by one, and rows that repeat both are one document. Rows without words
    stay, but for repetitions under one id. All columns of `docs` are returned, whatever their names.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("id"), "text", row_key(), F.struct("*").alias("doc")
    )
    groups = written(similar_groups(rows.select(F.col("row").alias("doc_id"), "text"), n, percent))
    # The group's own key is one of its rows: a group with another one has several.
    several = groups.filter("NOT kept").select(F.col("component_id").alias("group")).distinct()
    grouped = (
        groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
        .join(several, "group", "left_semi")
        .distinct()
    )
    members = written(grouped.join(rows.select("row", "id"), "row").distinct())
    first = members.groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    )
    dropped = members.join(first, "group").filter("row <> first.row").select("row").distinct()
    kept = _without(rows, written(dropped))
    # Rows of one key that are repeated; only then texts are shuffled to tell them apart.
    repeated = groups.groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept.select("doc.*")
    worded = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "")) > 0
    alone = F.col("id").isNull() & ~worded
    return (
        kept.filter(~alone).dropDuplicates(["row"]).select("doc.*")
        .union(kept.filter(alone).select("doc.*"))
    )


def query(docs: DataFrame) -> DataFrame:
    """Groups over sets of four-word shingles."""
    return similar_groups(docs, n=4)


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i
          FROM worded WHERE len(w) > 0)
  )
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * c >= 80 * (sa.n + sb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
  d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON a = d.doc_id
"""

"""MinHash near-duplicates with tensored banding; every link is confirmed on full shingle sets.

Two collections of SIDE short keys, each of ROWS minhashes, are combined to SIDE * SIDE table keys:
2 * SIDE * ROWS minhashes serve as many tables as SIDE * SIDE * 2 * ROWS would by plain banding. Two
sets of similarity s meet in a table unless no key of one collection agrees: 2 * (1 - s**ROWS)**SIDE
at most, which is 0.0006 at s = 0.8 and 2e-6 at s = 0.9 for the values here.

Equal sets are one node: they agree in size and in two independent 64-bit sums over their shingles; sets
that agree in the first alone are told apart. A table key that one node has alone is dropped before the tables are
formed. In each table key the smallest node is the pivot and is compared with the others; the links
make components. Where a key still holds several, its nodes outside the key's largest component are
put into blocks of BLOCK, and every node that shares a key with a block goes through it once: an
inverted index of the block's sets counts all its intersections together. That settles every pair
that shares a key and lies in different components, so no candidate is dropped, and no key's rows
are paired off all with all.

Texts without words are linked with nothing. Null ids come last in order and name no component
unless it has no other id. Rows equal in id and text are linked as equal sets are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, text_or_empty
from .components import components
from .repeats import NO_ID, keyed
from .textkit import Words, buffers, gram_hashes, mix64, range_hashes, slices

SHINGLE = 5
PERCENT = 80
SIDE = 8
ROWS = 2
#: Nodes outside their key's largest component that are compared together with the key's others.
BLOCK = 256
#: Nodes that one task compares with a block.
PART_ROWS = 4000

_SEEDS = mix64(np.arange(2 * SIDE * ROWS, dtype=np.uint64) + np.uint64(77))
_ODD = mix64(_SEEDS) | np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text of each), repeats included: k words, or all of a text that has fewer."""
    counts = words.counts
    if len(words.hashes) >= k:
        doc = words.doc[: len(words.hashes) - k + 1]
        whole = np.flatnonzero(doc == words.doc[k - 1 :])
        hashes, docs = gram_hashes(words.hashes, k)[whole], doc[whole]
    else:
        hashes, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        lone = range_hashes(words.hashes, words.first[short], words.first[short + 1])
        at = np.searchsorted(docs, short)
        hashes, docs = np.insert(hashes, at, lone), np.insert(docs, at, short)
    return hashes, docs


def shingle_set(raw: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(Words(raw, np.array([0, len(raw)]), lower=True), k)[0])


def signatures(words: Words, k: int) -> tuple[np.ndarray, ...]:
    """(set size, two fingerprints of the set, 2 * SIDE short keys) of each text."""
    hashes, docs = shingles(words, k)
    n = len(words.first) - 1
    size, total, check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    keys = np.zeros((n, 2 * SIDE), np.uint64)
    if len(hashes):
        _, once = np.unique(hashes ^ mix64(docs.astype(np.uint64)), return_index=True)
        size += np.bincount(docs[once], minlength=n)
        once = np.sort(once)
        begin = np.flatnonzero(np.concatenate(([True], docs[once[1:]] != docs[once[:-1]])))
        total[docs[once[begin]]] = np.add.reduceat(mix64(hashes[once]), begin)
        check[docs[once[begin]]] = np.add.reduceat(mix64(hashes[once] ^ _SEEDS[0]), begin)
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        for i in range(2 * SIDE * ROWS):
            x = (hashes ^ _SEEDS[i]) * _ODD[i]
            x ^= x >> np.uint64(29)
            least = np.minimum.reduceat(x * _ODD[i - 1], first)
            j = i // ROWS
            keys[docs[first], j] = mix64(keys[docs[first], j] + least)
    return size, mix64(total + size.astype(np.uint64)), mix64(check - size.astype(np.uint64)), keys


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                size, fp, check, keys = signatures(words, k)
                flat = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * 2 * SIDE, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("dk").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(size), pa.array(fp.view(np.int64)), pa.array(check.view(np.int64)), flat], names=["dk", "th", "n", "id", "check", "keys"])

    return run


SETS = "block long, part int, place int, id long, label long, shingles binary"
_SET_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _send_sets(k: int):
    """The full set of a text to every block that it is compared in."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SET_KINDS, strict=True)], names=["block", "part", "place", "id", "label", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows, held = [], 0
            for r, wanted in enumerate(batch.column("wanted").to_pylist()):
                made = shingle_set(data[offsets[r] : offsets[r + 1]], k).tobytes()
                for x in wanted:
                    rows.append((x["block"], x["part"], x["place"], x["id"], x["label"], made))
                    held += len(made)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


class _Block:
    """The sets that others are compared with, as an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.begin = np.unique(tokens[order], return_index=True)
        self.begin = np.append(self.begin, len(tokens))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, other: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, other), len(self.tokens) - 1)
        at = at[self.tokens[at] == other]
        n = self.begin[at + 1] - self.begin[at]
        where = np.arange(n.sum()) + np.repeat(self.begin[at] - np.cumsum(n) + n, n)
        common = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(other) - common))


def _compare(percent: int):
    """Rows come block by block, its own sets (place 0) first. Only links that join components are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, own, block, joined = None, [], None, {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for batch in batches:
            u, v = [], []
            columns = (batch.column(c).to_pylist() for c in ("block", "part", "place", "id", "label"))
            for r, (b, part, place, node, label) in enumerate(zip(*columns, strict=True)):
                made = np.frombuffer(batch.column("shingles")[r].as_buffer(), np.uint64)
                if (b, part) != which:
                    which, own, block, joined = (b, part), [], None, {}
                if place == 0:
                    if not own or own[-1][0] != node:
                        own.append((node, label, made.copy()))
                    continue
                block = block or _Block([x for _, _, x in own])
                for i in block.similar(made, percent):
                    a, z = root(own[i][1]), root(label)
                    if a != z:
                        joined[max(a, z)] = min(a, z)
                        u.append(own[i][0])
                        v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _confirm(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between a block's own nodes (place 0) and the nodes compared with them (place 1), on full sets.

    Rows of `wanted`: block, place, id, label. A block's other nodes are dealt out in parts of PART_ROWS.
    """
    # tables on the side of every join that is counted from its other side, so that a frequent key is split by it
    wanted, _ = materialise(wanted)
    parts, _ = materialise(wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).cast("int").alias("parts")))
    dealt = wanted.join(parts, "block")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    one = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.select("block", "place", "id", "label", F.explode(F.when(F.col("place") == 0, every).otherwise(one)).alias("part"))
    sent = dealt.join(nodes.select("id", "dk", "th"), "id").groupBy("dk", "th").agg(F.collect_list(F.struct("block", "part", "place", "id", "label")).alias("wanted"))
    sets = texts.join(sent, ["dk", "th"]).mapInArrow(_send_sets(k), SETS)
    return sets.repartition("block", "part").sortWithinPartitions("block", "part", "place", "id").mapInArrow(_compare(percent), "u long, v long")


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, id) of the tables: pairs of a short key of either collection that the node shares with another node."""
    short = nodes.select("id", F.posexplode("keys").alias("j", "value")).select("id", "j", F.xxhash64("j", "value").alias("short"))
    shared, _ = materialise(short.groupBy("short").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("short"))
    held = short.join(shared, "short").groupBy("id").agg(F.collect_list(F.struct("j", "short")).alias("all"))
    first, second = F.filter("all", lambda x: x["j"] < SIDE), F.filter("all", lambda x: x["j"] >= SIDE)
    pairs = held.select("id", F.explode(first).alias("a"), second.alias("bs")).select("id", "a", F.explode("bs").alias("b"))
    return pairs.select(F.xxhash64("a.j", "a.short", "b.j", "b.short").alias("key"), "id")


def across(places: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """What is left to compare: rows of `_confirm` for nodes that share a key and lie in different components."""
    labelled, labelled_path = materialise(places.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main, _ = materialise(sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "main"))
    mixed, _ = materialise(labelled.join(main, "key"))
    discard(places.sparkSession, labelled_path)
    outside = mixed.where("label <> main")
    # a node's home is the component that is largest where it is not, so that a group's blocks fill. Counts are tables of
    # their own: small ones are broadcast by their measured size, else both sides are plain shuffles that can be split
    crowd, _ = materialise(outside.groupBy("main").agg(F.count(F.lit(1)).alias("c")))
    home = outside.join(crowd, "main").groupBy("id", "label").agg(F.max(F.struct("c", "main")).alias("most"))
    home, _ = materialise(home.select("id", "label", F.col("most.main").alias("home")))
    parts, _ = materialise(home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(8 * block)).alias("parts")))
    home = home.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    turn = F.floor((F.row_number().over(Window.partitionBy("home", "part").orderBy("id")) - 1) / F.lit(block))
    homes = home.select("id", "label", F.xxhash64("home", "part", turn).alias("block"))
    # pairs of (component, block) first: far fewer than pairs of (key, block), and no node that shares a key is missed
    meets = outside.select("id", "main").distinct().join(homes.select("id", "block"), "id").select("main", "block").distinct()
    others = mixed.select("id", "label", "main").distinct().join(meets, "main").select("block", F.lit(1).alias("place"), "id", "label").distinct()
    return homes.select("block", F.lit(0).alias("place"), "id", "label").union(others)


def named_sets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, nodes): one node for each set; an id that stands for two sets (their checks differ) is replaced."""

    def distinct(rows: DataFrame) -> DataFrame:
        named = rows.where("n > 0").groupBy("id").agg(F.min(F.struct("dk", "th")).alias("f"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("keys").alias("keys"))
        return materialise(named.select("id", "f.dk", "f.th", "low", "high", "keys"))[0]

    nodes = distinct(signed)
    clash = nodes.where("low <> high").select("id", F.lit(True).alias("clash"))
    if not clash.isEmpty():
        own = F.when(F.col("clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))
        signed, _ = materialise(signed.join(clash, "id", "left").withColumn("id", own).drop("clash"))
        nodes = distinct(signed)
    return signed, nodes.drop("low", "high")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(dk, th, n_shingles, label) of every document; documents of one label are linked, directly or not."""
    texts = keyed(docs)
    signed, _ = materialise(texts.mapInArrow(_sign(shingle), "dk long, th long, n long, id long, check long, keys array<long>"))
    signed, nodes = named_sets(signed)
    keys = table_keys(nodes)
    keys, keys_path = materialise(keys)
    many, _ = materialise(keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most"))
    places, _ = materialise(keys.join(many, "key").select("key", "id", F.col("least").alias("pivot")))
    discard(docs.sparkSession, keys_path)

    met = places.where("id <> pivot").select("pivot", "id").distinct()
    pivots = met.select(F.col("pivot").alias("block"), F.lit(0).alias("place"), F.col("pivot").alias("id"), F.col("pivot").alias("label")).distinct()
    stars = met.select(F.col("pivot").alias("block"), F.lit(1).alias("place"), "id", F.col("id").alias("label")).union(pivots)
    links, _ = materialise(_confirm(stars, nodes, texts, shingle, percent))
    labels, _ = materialise(components(links))
    # a pivot has met all of its key
    rest, _ = materialise(_confirm(across(places.where("id <> pivot"), labels, block), nodes, texts, shingle, percent))
    if not rest.isEmpty():
        labels, _ = materialise(components(links.union(rest)))
    return signed.join(labels, "id", "left").select("dk", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "id")).alias("label"))


def _with_components(rows: DataFrame) -> DataFrame:
    # a table of its own, so that a component with a third of the rows is split by the join
    least, _ = materialise(rows.where("label is not null").groupBy("label").agg(F.min("dk").alias("least")))
    joined = rows.join(least, "label", "left")
    return joined.withColumn("least", F.coalesce("least", "dk"))


def component_digest(docs: DataFrame, shingle: int = 4, percent: int = PERCENT, **limits) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = _with_components(near_duplicates(docs.select("doc_id", "text"), shingle, percent, **limits))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return rows.select(real("dk").alias("doc_id"), "n_shingles", real("least").alias("component_id"), (F.col("dk") == F.col("least")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **limits) -> DataFrame:
    """One document of each group, with its own columns: that of the smallest id.

    Of several rows that share that id, one with the smallest text hash stays, and of those equal in id and
    text the one whose columns as JSON have the smallest md5; texts without words all stay.
    """
    rows = _with_components(near_duplicates(docs.select("doc_id", "text"), shingle, percent, **limits))
    gone = rows.where("label is not null").groupBy("label", "least").agg(F.min(F.struct("dk", "th")).alias("f"))
    stay = gone.select("f.dk", "f.th").distinct()
    text = text_or_empty()
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.rlike(r"[^\x20\x09-\x0D]").alias("worded"), F.struct(*docs.columns).alias("row"))
    worded = marked.where("worded").join(stay, ["dk", "th"], "left_semi")
    one = worded.groupBy("dk", "th").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return one.select("row.*").union(marked.where("not worded").select("row.*"))

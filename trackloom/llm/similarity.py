"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

A document is the set of its runs of five words (ASCII white space separates words, case is folded;
a shorter text is one run). Documents with the same set form a class of copies, which from here on
is one representative with a number of members. Every representative has a MinHash signature, cut
into one label per tree. The labels of a tree, sorted, are a prefix trie: representatives below one
node share a prefix. Matching starts at whole labels and shortens the prefix, level by level, until
a pair of the wanted similarity is found with the target recall (``stop_depth``). What lies below
the nodes of that level are the candidates.

Nothing expands a node into its pairs. A large node is cut into blocks; each pair of blocks is
compared inside one task on signatures, which returns links that hold similar members together, at
most one per member. Connected members are a family. A family is again cut into blocks, and each
pair of blocks is verified exactly on the word runs themselves: a task returns the number of links
per member and, again, at most one link per member.

The result has one row per document: ``doc_id``, ``class_id`` (smallest id connected by links),
``copy_of`` (smallest id with the same set) and ``n_links`` (other documents with similarity of at
least the threshold, copies included). Null, empty and white texts have no runs; each is its own
class without links. Rows with a null id take part in nothing and come back with nulls and 0 links.
Repeated rows are copies of each other; ids are expected to be unique otherwise, and different texts
with one id count as linked. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, mix, small_batches, stored, word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 20
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
#: Pairs whose signatures agree in less than this share hold no family together. At similarity 0.8
#: and 80 values the share has a standard deviation of 0.045, so 0.55 is 5.6 deviations away.
LEAST_AGREEMENT = 0.55
#: Members of one block. A task compares two blocks.
BLOCK = 512
#: Word runs of one block's members together, about.
BLOCK_RUNS = 400_000
#: Rounds of the component search before it gives up; each at least halves long chains.
MAX_ROUNDS = 40

SIGNED = "id long, copy_key binary, size long, signature binary"
RUNS = "id long, root long, copies long, runs binary"


def runs_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs of a text."""
    hashes, _ = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    if len(hashes) < words:
        words = len(hashes)
    many = len(hashes) - words + 1
    key = hashes[:many].copy()
    for k in range(1, words):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + many]
    return np.unique(mix(key))


def stop_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = MAX_DEPTH, recall: float = TARGET_RECALL) -> int:
    """Prefix length at which shortening may stop: pairs at the threshold are found with ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 1 << 63, values, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, values, np.uint64)


def signature(runs: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of a set of hashes."""
    times, plus = seeds
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for at in range(0, len(runs), 4096):
        part = runs[None, at : at + 4096] * times[:, None] + plus[:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """``(id, copy_key, size, signature)`` of all ``(id, text)`` rows; key and signature are null without runs.

    ``copy_key`` is a digest of the set of runs, ``size`` their number.
    """
    seeds = _seeds(trees * depth)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, signs, sizes = [], [], []
            for text in batch["text"]:
                runs = runs_of(text if isinstance(text, str) else "")
                sizes.append(len(runs))
                keys.append(hashlib.blake2b(runs.tobytes(), digest_size=16).digest() if len(runs) else None)
                signs.append(signature(runs, seeds).astype(">u4").tobytes() if len(runs) else None)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "copy_key": keys, "size": sizes, "signature": signs})

    small_batches(docs.sparkSession)
    return docs.select("id", "text").mapInPandas(sign, SIGNED)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to each group of rows, many small groups per batch.

    Groups must be of bounded size: the rows of one group are held together, no more.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            cuts = _cuts(batch)
            if len(cuts) > 2:
                yield pd.concat([work(batch.iloc[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1])])
            rest = batch.iloc[cuts[-2] :] if len(batch) else None
        if rest is not None:
            yield work(rest)

    def _cuts(batch: pd.DataFrame) -> list[int]:
        values = batch[keys].to_numpy()
        new = (values[1:] != values[:-1]).any(axis=1)
        return [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]

    return df.repartition(*keys).sortWithinPartitions(*keys, "id").mapInPandas(walk, schema)


def spanning(links: np.ndarray) -> np.ndarray:
    """(n, 2) positions of at most n - 1 links with the same components as a boolean matrix."""
    n = len(links)
    label = np.full(n, -1)
    out = []
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        edge = [root]
        while edge:
            at = edge.pop()
            new = np.flatnonzero(links[at] & (label < 0))
            label[new] = root
            out += [(at, k) for k in new]
            edge += new.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def between(links: np.ndarray) -> np.ndarray:
    """The same for two blocks: positions (row, column + rows)."""
    rows, columns = links.shape
    whole = np.zeros((rows + columns,) * 2, bool)
    whole[:rows, rows:] = links
    whole[rows:, :rows] = links.T
    return spanning(whole)


def blocks_for(n: Column, total: Column | None = None) -> Column:
    """Number of blocks for ``n`` members with ``total`` runs: long texts make blocks of fewer members."""
    by_count = F.ceil(n / BLOCK).cast("int")
    return by_count if total is None else F.greatest(by_count, F.ceil(total / BLOCK_RUNS).cast("int"))


def in_block_pairs(members: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Members of the groups in ``sizes`` (columns: group, ``_k``), repeated for each pair of blocks.

    Adds ``_a``, ``_b`` (the pair of blocks, _a <= _b) and ``_in`` (the member's own block). A group
    of n members in k blocks is repeated k times; no row stands for a pair of members.
    """
    return (
        members.join(sizes, group)
        .withColumn("_in", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("_a", F.least("_in", "_other")).withColumn("_b", F.greatest("_in", "_other"))
        .drop("_other", "_k")
    )


def sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of the members of both blocks, and whether they are two."""
    block, a, b = rows["_in"].to_numpy(), rows["_a"].iloc[0], rows["_b"].iloc[0]
    return np.flatnonzero(block == a), np.flatnonzero(block == b), a != b


def family_links(signs: DataFrame, trees: int, depth: int) -> DataFrame:
    """``(src, dst)`` links of candidates whose signatures agree enough, at most one per member and task."""
    width = 4 * depth
    nodes = signs.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "id", F.xxhash64("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})")).alias("node")
    )
    # the same members often meet in several trees: each set of members is compared once
    sizes = (
        nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_who"))
        .where("n > 1").groupBy("n", "_who").agg(F.min("node").alias("node"))
        .select("node", blocks_for(F.col("n")).alias("_k"))
    )
    placed = in_block_pairs(nodes, sizes, "node").join(signs.select("id", "signature"), "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, pair = sides(rows)
        ids = rows["id"].to_numpy()
        values = np.frombuffer(b"".join(rows["signature"]), ">u4").reshape(len(rows), -1).astype(np.uint32)
        near = agreement(values[left], values[right]) >= LEAST_AGREEMENT * values.shape[1]
        ends = between(near) if pair else spanning(near)
        names = np.concatenate([ids[left], ids[right]]) if pair else ids[left]
        return pd.DataFrame({"src": names[ends[:, 0]], "dst": names[ends[:, 1]]})

    return by_group(placed, ["node", "_a", "_b"], compare, "src long, dst long").where("src <> dst").distinct()


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values two lists of signatures share, pair by pair."""
    if len(left) * len(right) <= 1024:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2)
    agree = np.zeros((len(left), len(right)), np.int16)
    for column in range(left.shape[1]):
        agree += left[:, column][:, None] == right[:, column][None, :]
    return agree


def components(links: DataFrame) -> DataFrame:
    """``(id, root)``: the smallest id connected to each id that occurs in ``(src, dst)`` links.

    Alternating large-star and small-star steps: every step hooks neighbours to the smallest
    neighbour known, and no step makes more links than it got. Steps end when nothing changes.
    """
    edges = stored(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join below is a plain one, which Spark can split where many meet in one hub
        least = stored(both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = stored(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        hooked = large.join(low, "u")
        small = hooked.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            low.select("u", F.col("_m").alias("v"))
        )
        edges = stored(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def run_lists(members: DataFrame) -> DataFrame:
    """``(id, root, copies, runs)`` of ``(id, root, copies, text)`` rows."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "root", "copies"]].assign(runs=[runs_of(t).tobytes() for t in batch["text"]])

    return members.select("id", "root", "copies", "text").mapInPandas(extract, RUNS)


def verified(families: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside families of ``(id, root, copies, runs)``.

    Returns ``(id, n_links, other)``: the documents a member links to in a task, and rows with
    ``other`` for links that hold the group together.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, pair = sides(rows)
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        sets = [np.frombuffer(r, np.uint64) for r in rows["runs"]]
        near = similar([sets[i] for i in left], [sets[i] for i in right], threshold)
        if pair:
            names, ends = np.concatenate([ids[left], ids[right]]), between(near)
            counts = np.concatenate([near @ copies[right], near.T @ copies[left]])
        else:
            np.fill_diagonal(near, False)
            names, ends, counts = ids[left], spanning(near), near @ copies[left]
        return pd.DataFrame({
            "id": np.concatenate([names, names[ends[:, 0]]]),
            "n_links": np.concatenate([counts, np.zeros(len(ends), np.int64)]),
            "other": np.concatenate([np.full(len(names), -1), names[ends[:, 1]]]),
            "link": np.repeat([False, True], [len(names), len(ends)]),
        })

    return by_group(
        in_block_pairs(families, sizes, "root"), ["root", "_a", "_b"], compare,
        "id long, n_links long, other long, link boolean",
    ).where("link or n_links > 0")


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of two lists have a Jaccard similarity of at least ``threshold``.

    Runs found in one set only cannot be shared and are left out of the matrices; the rest are
    counted in slices of columns, so that memory stays bounded whatever the texts' lengths.
    """
    sizes_l = np.array([len(s) for s in left], np.int64)
    sizes_r = np.array([len(s) for s in right], np.int64)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([sizes_l, sizes_r]))
    keys, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    owner, column = owner[seen[column] > 1], column[seen[column] > 1]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for low in range(0, len(keys), step):
        first, last = np.searchsorted(column, (low, low + step))
        if first == last:
            continue
        used, place = np.unique(column[first:last], return_inverse=True)
        who = owner[first:last]
        matrix = np.zeros((len(left) + len(right), len(used)), np.float32)
        matrix[who, place] = 1
        common += matrix[: len(left)] @ matrix[len(left) :].T
    together = sizes_l[:, None] + sizes_r[None, :] - common
    return common >= threshold * together - 1e-6


def join_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL) -> DataFrame:
    """Classes and link counts of all documents; see the module text for the columns."""
    depth = stop_depth(threshold, trees, MAX_DEPTH, recall)
    texts = chosen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = stored(signed(texts, trees, depth))
    known = rows.where(F.col("id").isNotNull() & F.col("copy_key").isNotNull())
    alone = rows.where(F.col("id").isNull() | F.col("copy_key").isNull())

    # copies have the same set and so the same signature
    heads = stored(known.groupBy("copy_key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")
    ))
    near = components(family_links(heads.select("id", "signature"), trees, depth))
    members = (
        texts.join(near.join(heads.select("id", "copies"), "id"), "id")
        .groupBy("id", "root", "copies").agg(F.min("text").alias("text"))
    )
    sizes = near.join(heads.select("id", "size"), "id").groupBy("root").agg(
        blocks_for(F.count("*"), F.sum("size")).alias("_k")
    )
    checked = stored(verified(run_lists(members), sizes, threshold))
    groups = components(checked.where("link").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    counts = checked.groupBy("id").agg(F.sum("n_links").alias("_links"))

    head = (
        heads.select("id", "copy_key", "copies").join(counts, "id", "left").join(groups, "id", "left")
        .select(
            "copy_key", F.col("id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"),
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    linked = known.select("id", "copy_key").join(head, "copy_key").select(F.col("id").alias("doc_id"), "class_id", "copy_of", "n_links")
    single = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(single)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class; all columns of ``docs``.

    Repeated rows of that id are the same document and stay once; rows with a null id all stay.
    """
    found = join_near_duplicates(docs, threshold).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))

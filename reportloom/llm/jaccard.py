"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document is the set of its distinct shingles, known by 48 bits of a hash and the number
of its hash range, of which there are more the larger the corpus; beyond 65,536 ranges that
is the whole hash of 64 bits.  Two documents link when 100 * intersection >= threshold * union.

1. *Frequencies.*  A task cuts its rows into blocks and sends each hash range one blob
   per block, of seven bytes a hash, however many ranges there are; hashes that several
   documents of the block share are sent once, with their count.  A range counts its hashes and answers with those that occur in more
   than one document.  Nothing else of a document matters: a shingle that occurs
   nowhere else links nobody, and a document that shares less than the least possible
   intersection is alone.
2. *Classes.*  Documents of equal sets are one class from here on.
3. *Groups.*  Shingles are ordered rarest first.  A class whose set has n shingles can
   only link to one with a common shingle among its first n - ceil(t * n) + 1.  Classes
   of equal size and equal prefix are one group.
4. *Neighbourhoods.*  Groups that share a prefix shingle, directly or through others,
   form a neighbourhood: a star per shingle, then connected components.
5. *Verification.*  A neighbourhood's classes are cut into blocks of bounded size, and
   every two blocks meet in one task, which joins their groups on prefix shingles,
   filters the pairs of groups by size, expands them and verifies the members exactly.
   It returns the number of links of each class and a spanning forest, so no pair
   leaves the task; small neighbourhoods share a task.

Defined results: words are split at ASCII blanks after lower-casing A-Z; a text with
fewer words than a shingle is one shingle; a null or blank text has none and is linked
with nothing; a null id is linked with nothing and has a null component; rows of equal
id are rows of one document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stage import give_back, giving_back, release, staged, whole_text
from .vocab import text_groups

SENT = "key long, block long, bucket long, " + ", ".join(f"b{i} binary" for i in range(8))
CLASSES = "digest binary, n_shingles long, doc_ids array<long>, shared binary"
FOREST = "class_id long, root long, n_linked long"
_NAMES = ["key", "block", "bucket", *(f"b{i}" for i in range(8))]
_LOW = np.uint64((1 << 48) - 1)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    size = min(words, n)
    count = n - size + 1
    out = hashes[:count].copy()
    for j in range(1, size):
        out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9) + hashes[j : j + count]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def least_shared(n: np.ndarray | int, threshold: int):
    """The smallest intersection a set of n can have with a set it links to."""
    return -(-threshold * n // 100)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _high(bucket: int, buckets: int) -> int:
    """The upper 16 bits of the names of a bucket's hashes, from its number."""
    return bucket >> max(0, (buckets - 1).bit_length() - 16)


def _name(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as its bucket knows it: 48 bits and the bucket's number.

    Beyond 65,536 buckets, a power of two then, the number holds the other 16 bits of the hash.
    """
    if buckets > 1 << 16:
        return hashes
    return (hashes & _LOW) | (_bucket(hashes, buckets) << np.uint64(48))


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers as their differences, a byte each; 255 says that more follows."""
    steps = np.diff(ascending, prepend=0)
    over = steps // 255
    out = np.full(int(over.sum()) + len(steps), 255, dtype=np.uint8)
    out[np.cumsum(over + 1) - 1] = steps % 255
    return out.tobytes()


def _stepped(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    reach = np.cumsum(steps, dtype=np.int64)
    return reach[steps < 255]


def _packed(hashes: np.ndarray) -> tuple[bytes, bytes]:
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((hashes >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)


@giving_back
def _send(words: int, buckets: int, chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs for the hash ranges, and a record of each block that finds its way to the block."""
    task, number = TaskContext.get().partitionId(), 0
    for part, texts in text_groups(batches, chars=chars):
        block, number = task << 32 | number, number + 1
        ids = part.column(part.schema.get_field_index("doc_id"))
        sets = [shingles(t, words) for t in texts]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
        first: dict[bytes, int] = {}
        # Equal sets are one class; rows without shingles or id stay alone.
        owner, alone = np.empty(len(sets), dtype=np.int64), []
        for i, (digest, doc) in enumerate(zip(digests, ids.to_pylist())):
            if not digest or doc is None:
                owner[i] = -1
                alone.append((doc, len(sets[i])))
            else:
                owner[i] = first.setdefault(digest, len(first))
        own = [None] * len(first)
        for i, c in enumerate(owner):
            if c >= 0 and own[c] is None:
                own[c] = sets[i]
        sizes = np.array([len(s) for s in own], dtype=np.int64)
        flat = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
        of = np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, dtype=bool)
        run = np.cumsum(new) - 1
        times = np.bincount(run) if len(run) else np.zeros(0, dtype=np.int64)
        single = times[run] == 1 if len(run) else new
        common, common_times = flat[new][times > 1], times[times > 1]
        # Shared within the block: the record keeps whose they are.
        place = np.cumsum(times > 1) - 1
        refs, refs_of = place[run[~single]], of[~single]
        by_class = np.argsort(refs_of, kind="stable")
        members = np.flatnonzero(owner >= 0)
        members = members[np.argsort(owner[members], kind="stable")]
        known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        record = [
            b"".join(first),
            sizes.astype("<i8").tobytes(),
            known[members].astype("<i8").tobytes(),
            np.bincount(owner[members], minlength=len(own)).astype("<i8").tobytes() if len(own) else b"",
            _name(common, buckets).astype("<u8").tobytes(),
            refs[by_class].astype("<u4").tobytes(),
            np.bincount(refs_of, minlength=len(own)).astype("<i8").tobytes() if len(own) else b"",
            np.array([(d or 0, d is None, n) for d, n in alone], dtype="<i8").tobytes(),
        ]
        rows = [(-1 - block, block, -1, *record)]
        flat, of = flat[single], of[single]
        ranges, ranges_common = _bucket(flat, buckets), _bucket(common, buckets)
        for b in np.union1d(ranges, ranges_common):
            mine = slice(*np.searchsorted(ranges, [b, b + np.uint64(1)]))
            theirs = slice(*np.searchsorted(ranges_common, [b, b + np.uint64(1)]))
            whose = np.argsort(of[mine], kind="stable")
            shared = _packed(common[theirs])
            times_of = common_times[theirs].astype("<u4").tobytes()
            rows.append((int(b), block, int(b), *_packed(flat[mine][whose]), _steps(of[mine][whose]), *shared, times_of, None, None))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows))], names=_NAMES
        )


def _answer(buckets: int, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range, for every block: what occurs in other documents too."""
    give_back()
    if key[0] < 0:
        return frame
    tokens = [_unpacked(a, b) for a, b in zip(frame["b0"], frame["b1"])]
    common = [_unpacked(a, b) for a, b in zip(frame["b3"], frame["b4"])]
    flat = np.concatenate([*tokens, *common])
    times = np.concatenate([np.ones(sum(map(len, tokens)), dtype=np.int64), *(np.frombuffer(c, "<u4") for c in frame["b5"])])
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    total = np.add.reduceat(times[order], np.flatnonzero(new))
    seen = np.empty(len(flat), dtype=np.int64)
    seen[order] = total[np.cumsum(new) - 1]
    seen = np.minimum(seen, 0xFFFFFFFF)
    high = np.uint64(_high(int(key[0]), buckets) if buckets > 1 << 16 else int(key[0])) << np.uint64(48)
    out, at, at_common = [], 0, sum(map(len, tokens))
    for i in range(len(frame)):
        own = seen[at : at + len(tokens[i])]
        often = own > 1
        whose = _stepped(frame["b2"].iloc[i])[often]
        out.append(
            (
                (tokens[i][often] | high).astype("<u8").tobytes(),
                own[often].astype("<u4").tobytes(),
                whose.astype("<u4").tobytes(),
                seen[at_common : at_common + len(common[i])].astype("<u4").tobytes(),
            )
        )
        at += len(tokens[i])
        at_common += len(common[i])
    answer = frame[["key", "block", "bucket"]].copy()
    for i, column in enumerate(zip(*out)):
        answer[f"b{i}"] = column
    for i in range(4, 8):
        answer[f"b{i}"] = None
    return answer


def _classes(threshold: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Of one block: its classes, with the shared shingles of those that may link, rarest first."""
    give_back()
    frame = frame.sort_values("bucket")
    record, answers = frame.iloc[0], frame.iloc[1:]
    digests, sizes = record["b0"], np.frombuffer(record["b1"], "<i8")
    members = np.split(np.frombuffer(record["b2"], "<i8"), np.cumsum(np.frombuffer(record["b3"], "<i8"))[:-1])
    common, refs = np.frombuffer(record["b4"], "<u8"), np.frombuffer(record["b5"], "<u4")
    refs_of = np.repeat(np.arange(len(sizes)), np.frombuffer(record["b6"], "<i8"))
    joined = lambda i, kind: np.frombuffer(b"".join(answers[f"b{i}"]), kind)
    common_seen = joined(3, "<u4")
    token = np.concatenate([joined(0, "<u8"), common[refs]])
    seen = np.concatenate([joined(1, "<u4"), common_seen[refs]])
    of = np.concatenate([joined(2, "<u4").astype(np.int64), refs_of])
    shared = np.bincount(of, minlength=len(sizes))
    linked = shared >= least_shared(sizes, threshold)
    keep = linked[of] if len(of) else np.zeros(0, dtype=bool)
    token, seen, of = token[keep], seen[keep], of[keep]
    token = token[np.lexsort((token, seen, of))]
    ends = np.cumsum(np.where(linked, shared, 0))
    rows = [
        (
            digests[16 * c : 16 * c + 16],
            int(sizes[c]),
            members[c].tolist(),
            token[ends[c] - shared[c] : ends[c]].tobytes() if linked[c] else None,
        )
        for c in range(len(sizes))
    ]
    alone = np.frombuffer(record["b7"], "<i8").reshape(-1, 3)
    rows += [(None, int(n), [None if missing else int(d)], None) for d, missing, n in alone]
    return pd.DataFrame(rows, columns=["digest", "n_shingles", "doc_ids", "shared"], dtype=object)


@giving_back
def _prefixes(threshold: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shared shingles in the prefix: those that occur nowhere else come first in it."""
    for frame in frames:
        keep = frame["shared"].map(len) // 8 - least_shared(frame["n_shingles"], threshold) + 1
        prefix = [s[: 8 * k] for s, k in zip(frame.pop("shared"), keep)]
        yield frame.assign(prefix=prefix)


@giving_back
def _postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        tokens = [np.frombuffer(p, "<i8") for p in frame["prefix"]]
        yield pd.DataFrame(
            {
                "token": np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64),
                "group_id": np.repeat(frame["group_id"].to_numpy(), [len(t) for t in tokens]),
            }
        )


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _verify(threshold: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Links among the classes of a task: only across its two sides where it has two."""
    give_back()
    frame = frame.sort_values(["n_shingles", "class_id"], kind="stable").reset_index(drop=True)
    ids, n = frame["class_id"].to_numpy(), frame["n_shingles"].to_numpy()
    copies, side = frame["copies"].to_numpy(), frame["side"].to_numpy()
    across = bool(frame["low"].iloc[0] != frame["high"].iloc[0])  # else all are of one block
    sets = [np.frombuffer(s, "<u8") for s in frame["shared"]]
    lengths = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    # Groups: members of equal size and prefix, in the order of their first member.
    names, group = np.unique(frame["group_id"].to_numpy(), return_inverse=True)
    head = np.full(len(names), len(ids))
    np.minimum.at(head, group, np.arange(len(ids)))
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    reach = lengths - least_shared(n, threshold) + 1
    heads = np.argsort(head)
    tokens = np.concatenate([flat[begins[head[g]] : begins[head[g]] + reach[head[g]]] for g in heads])
    posted = np.repeat(np.arange(len(heads)), reach[head[heads]])
    by_token = np.argsort(tokens, kind="stable")
    lists = np.searchsorted(tokens[by_token], np.arange(flat.max() + 2))
    posted_by_token = posted[by_token]
    n_of = n[head[heads]]
    parent, linked = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    for x, g in enumerate(heads):
        own = flat[begins[head[g]] : begins[head[g]] + reach[head[g]]]
        near = np.unique(np.concatenate([posted_by_token[lists[t] : lists[t + 1]] for t in own]))
        # Filter of group pairs: later ones in order of size, none too large; x itself pairs its members.
        near = near[(near >= x) & (100 * n_of[x] >= threshold * n_of[near])]
        others = np.concatenate([members[heads[y]] for y in near])
        others.sort()
        for i in members[g]:
            with_ = others[others > i]
            if across:
                with_ = with_[side[with_] != side[i]]
            if not len(with_):
                continue
            mine = flat[begins[i] : ends[i]]
            mark[mine] = True
            spans = np.arange(lengths[with_].sum()) - np.repeat(np.cumsum(lengths[with_]) - lengths[with_], lengths[with_])
            hit = mark[flat[np.repeat(begins[with_], lengths[with_]) + spans]]
            both = np.add.reduceat(hit, np.cumsum(lengths[with_]) - lengths[with_], dtype=np.int64)
            mark[mine] = False
            for j in with_[100 * both >= threshold * (n[i] + n[with_] - both)]:
                linked[i] += copies[j]
                linked[j] += copies[i]
                a, b = _root(parent, i), _root(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([_root(parent, i) for i in range(len(ids))], dtype=np.int64)
    return pd.DataFrame({"class_id": ids, "root": ids[roots], "n_linked": linked})


def _set_classes(rows: DataFrame, words: int, threshold: int, bucket_bytes: int, block_chars: int) -> DataFrame:
    """Classes of equal sets in each block, with the shingles that occur in other documents too."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // bucket_bytes))
    if buckets > 1 << 16:
        buckets = 1 << (buckets - 1).bit_length()
    sent = rows.mapInArrow(functools.partial(_send, words, buckets, block_chars), SENT)
    answered = sent.groupBy("key").applyInPandas(functools.partial(_answer, buckets), SENT)
    return staged(answered.groupBy("block").applyInPandas(functools.partial(_classes, threshold), CLASSES), "classes")


def join(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    threshold: int = 75,
    bucket_bytes: int = 6_000_000,
    block_chars: int = 4_000_000,
    task_shingles: int = 2_000_000,
    task_classes: int = 4096,
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, n_links`` of every row.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest
    reachable by links, ``n_links`` the number of other rows linked directly.  The
    remaining parameters bound what one task holds.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    classes = _set_classes(rows, words, threshold, bucket_bytes, block_chars)
    release(docs.sparkSession)  # all shingles went through its shuffles
    linkable = (
        classes.filter(F.col("shared").isNotNull())
        .groupBy("digest")
        .agg(
            F.min(F.array_min("doc_ids")).alias("class_id"),
            F.sum(F.size("doc_ids")).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("shared").alias("shared"),
        )
    )
    sets = staged(linkable, "sets")
    # Groups of equal size and prefix.  Different documents may have the same smallest id only if ids repeat.
    prefixed = sets.select("digest", "class_id", "n_shingles", "shared").mapInPandas(
        functools.partial(_prefixes, threshold), "digest binary, class_id long, n_shingles long, prefix binary"
    )
    key_of = F.xxhash64("n_shingles", "prefix")
    groups = staged(prefixed.withColumn("group_id", key_of), "groups")
    first = groups.groupBy("group_id").agg(F.first("prefix").alias("prefix"))
    postings = first.mapInPandas(_postings, "token long, group_id long")
    stars = postings.groupBy("token").agg(F.min("group_id").alias("v"), F.count("*").alias("n")).filter("n > 1")
    edges = postings.join(stars, "token").select(F.col("group_id").alias("u"), "v")
    near = components(edges)
    placed = groups.select("digest", "group_id", "n_shingles").join(
        near.select(F.col("node").alias("group_id"), "component"), "group_id", "left"
    ).withColumn("area", F.coalesce("component", "group_id"))
    weight = F.sum("n_shingles").alias("weight")
    areas = placed.groupBy("area").agg(F.count("*").alias("members"), weight).filter("members > 1")
    cuts = F.ceil(F.greatest(F.col("members") / F.lit(task_classes), F.col("weight") / F.lit(task_shingles)))
    areas = areas.withColumn("cuts", cuts.cast("int"))
    shards = max(1, -(-int(areas.agg(F.sum("weight")).first()[0] or 0) // task_shingles))
    # A small neighbourhood shares a task; in a large one every two blocks have one.
    mine = F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    tasks = (
        placed.join(areas, "area")
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select(
            "digest",
            "group_id",
            F.when(F.col("cuts") > 1, F.col("mine")).otherwise(F.lit(0)).alias("side"),
            F.when(F.col("cuts") > 1, F.col("area")).otherwise(F.pmod("area", F.lit(shards))).alias("area"),
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            (F.col("cuts") > 1).alias("cut"),
        )
    )
    members = tasks.join(sets, "digest").drop("digest")
    forest = staged(
        members.groupBy("cut", "area", "low", "high").applyInPandas(functools.partial(_verify, threshold), FOREST),
        "forest",
    )
    links = forest.groupBy("class_id").agg(F.sum("n_linked").alias("n_linked"))
    whole = components(forest.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    known = (
        sets.select("digest", "class_id", "copies")
        .join(links, "class_id", "left")
        .join(whole.withColumnRenamed("node", "class_id"), "class_id", "left")
    )
    local = F.array_min("doc_ids")
    rows = F.size("doc_ids").cast("long")
    return classes.join(known, "digest", "left").select(
        F.explode("doc_ids").alias("doc_id"),
        "n_shingles",
        F.coalesce("class_id", local).alias("class_id"),
        F.coalesce("component", "class_id", local).alias("component_id"),
        (F.coalesce("n_linked", F.lit(0)) + F.coalesce("copies", rows) - 1).alias("n_links"),
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each component the document of the smallest id stays; rows without id stay.

    Of rows of that id with equal texts one stays, that of the smallest hash over all its
    columns; rows of that id with other texts are not dropped for it, since an id that
    stays does so with all its texts.
    """
    found = join(docs, key=key, text=text, **options).filter(F.col("doc_id") == F.col("component_id"))
    kept = staged(found.select(F.col("doc_id").alias(key)).distinct(), "kept")
    del found
    release(docs.sparkSession)  # before the texts are shuffled
    named = docs.filter(F.col(key).isNotNull())
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    first = F.min_by(F.struct(*docs.columns), order)
    own = named.join(kept, key, "left_semi").groupBy(F.col(key).alias("_k"), F.xxhash64(text).alias("_t")).agg(first.alias("_row"))
    return own.select("_row.*").unionByName(docs.filter(F.col(key).isNull()))

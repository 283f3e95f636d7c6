"""Spelling variants: words one edit apart, found by walking tries level by level.

1. *Words.*  Tasks count the letter runs of their slices of text; counts are added up and
   the frequent words stay.
2. *Tries.*  The words and their reversals form two tries.  A node is the hash of a
   prefix; nodes where words part, or where one ends and another goes on, are kept, and
   an edge carries the letters between two of them.  Edges are a distributed table of at most
   two rows per node and next letter.
3. *Frontier.*  States are (word, position, node, edits), the position as the rest of the
   word.  Two words one edit apart share their first half or their last one, so states
   start with no edit at the kept nodes in the second half of a word's own path.  The
   first join takes the edge of another letter, replacing or inserting its first one, which
   is enough: an edit can always be moved to the first difference.  Every further join
   takes the edges that agree with the rest, until no state is left.  A state without
   rest at the end of a word is a pair; deletions are the insertions seen from the other word.
   Pairs whose words share the first half come from the forward trie, the others from
   the reversed one.  Every pair is checked by its edit distance, since hashes name the nodes.
4. *Forms.*  A word's form is its near word of largest count, if that is large enough; roots
   follow forms, whose counts grow by ``ratio`` each, by doubling the steps.

Joins are on nodes, of which a hot one has many states but few edges: a small side is
broadcast by its size on file, a hot key is split at run time.  The rounds are as many as there are
kept nodes in the second half of a word.

Defined results: a null text has no words; rows of null id are counted like any other;
equal words are one row; ties for the form go to the smaller word; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged, whole_text
from .vocab import text_slices

LETTERS = "A-Za-zÀ-ÿ"
#: What a document does to its runs: from its id to a function of the lower-cased run.
Alter = Callable[[int | None], Callable[[str], str]]


def _counts(least: int, letters: str, alter: Alter | None, chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each slice with their counts."""
    found = re.compile(f"[{letters}]{{{least},}}").findall
    for part, texts in text_slices(batches, chars=chars):
        counts: Counter[str] = Counter()
        ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
        for doc, text in zip(ids, texts.cast(pa.binary()).to_pylist()):
            runs = found(text.lower().decode("utf-8", "replace"))  # bytes: only A-Z change
            if alter is None:
                counts.update(runs)
            else:
                changed = alter(doc)
                for run, n in Counter(runs).items():
                    counts[changed(run)] += n
        kept = [(w, n) for w, n in counts.items() if len(w) >= least]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"]
        )


def count_words(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    least: int = 6,
    frequent: int = 5,
    letters: str = LETTERS,
    alter: Alter | None = None,
    chars: int = 4_000_000,
) -> DataFrame:
    """``word, n`` of the runs of at least ``least`` letters that occur ``frequent`` times."""
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    counted = rows.mapInArrow(functools.partial(_counts, least, letters, alter, chars), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)


def _from(c: Column, at) -> Column:
    """Characters from a 0-based place on."""
    return F.substr(c, F.lit(at) + F.lit(1), F.length(c))


def _paths(words: DataFrame, half: int) -> DataFrame:
    """``id, way, word, n, spelled, path``: kept places of each word in both tries, from ``half`` letters on."""
    both = words.select("id", "word", "n", F.lit(0).alias("way"), F.col("word").alias("spelled")).union(
        words.select("id", "word", "n", F.lit(1), F.reverse("word"))
    )
    places = both.select(
        "id", "way", "spelled", F.explode(F.sequence(F.lit(half), F.length("spelled"))).alias("place")
    ).select(
        "id",
        "way",
        "place",
        _node(F.col("way"), F.col("spelled"), F.col("place")).alias("node"),
        F.substr("spelled", F.col("place") + 1, F.lit(1)).alias("next"),  # empty where the word ends
    )
    parting = places.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).filter("a <> b").select("node")
    kept = places.select("id", "way", "place", "node").join(parting, "node", "left_semi")
    path = kept.groupBy("id", "way").agg(F.array_sort(F.collect_list("place")).alias("path"))  # at most one a letter
    return both.join(path, ["id", "way"])


def _node(way: Column, spelled: Column, place: Column) -> Column:
    return F.xxhash64(way, F.substr(spelled, F.lit(1), place))


def _tries(words: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``node, label, child, to, to_n`` and states ``word, n, way, rest, node`` without edits.

    An edge leads on to a kept node or, with ``to``, to the end of a word.
    """
    paths = staged(_paths(words, half), "paths")
    here, after = F.col("path")[F.col("i")], F.get("path", F.col("i") + 1)
    size = F.length("spelled")
    at = paths.select("*", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("i")).filter(here < size)
    label = F.substr("spelled", here + 1, F.coalesce(after, size) - here)
    node = _node(F.col("way"), F.col("spelled"), here)
    inner = at.filter(after.isNotNull()).select(
        node.alias("node"),
        label.alias("label"),
        _node(F.col("way"), F.col("spelled"), after).alias("child"),
        F.lit(None).cast("string").alias("to"),
        F.lit(None).cast("long").alias("to_n"),
    )
    last = at.filter(F.coalesce(after, size) == size).select(
        node.alias("node"), label.alias("label"), F.lit(None).cast("long").alias("child"), F.col("word").alias("to"), F.col("n").alias("to_n")
    )
    states = paths.select("*", F.explode(F.filter("path", lambda p: p >= F.floor(size / 2))).alias("place"))
    return (
        staged(inner.distinct().union(last), "edges"),
        states.select(
            "word",
            "n",
            "way",
            _from(F.col("spelled"), F.col("place")).alias("rest"),
            _node(F.col("way"), F.col("spelled"), F.col("place")).alias("node"),
        ),
    )


def _moved(joined: DataFrame, rest: Column) -> DataFrame:
    """States after a join: at a node with a rest, or at a word without one."""
    return joined.withColumn("rest", rest).filter(
        F.when(F.col("to").isNull(), F.col("rest") != "").otherwise(F.col("rest") == "")
    ).select("word", "n", "way", "rest", F.col("child").alias("node"), "to", "to_n")


def near_words(words: DataFrame, *, half: int = 3) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words exactly one edit apart.

    ``words`` has distinct ``word`` and ``n``; ``half`` is at most half of the length of the shortest.
    """
    words = staged(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    edges, states = _tries(words, half)
    letter, label, tail = F.substr("rest", F.lit(1), F.lit(1)), F.col("label"), _from(F.col("label"), 1)
    first = F.substr("label", F.lit(1), F.lit(1))
    replaced = (F.length("rest") >= F.length(label)) & F.startswith(_from(F.col("rest"), 1), tail)
    inserted = F.startswith(F.col("rest"), tail)
    other = states.join(edges, "node").filter((letter != first) & (replaced | inserted))
    rests = F.array_compact(
        F.array(
            F.when(replaced, _from(F.col("rest"), F.length(label))),
            F.when(inserted, _from(F.col("rest"), F.length(label) - 1)),
        )
    )
    frontier = staged(_moved(other.withColumn("left", F.explode(rests)), F.col("left")), "frontier")
    pairs = frontier.filter(F.col("to").isNotNull())
    onward = edges.withColumn("letter", first)
    while not (open_ := frontier.filter(F.col("to").isNull()).drop("to", "to_n")).isEmpty():
        same = open_.withColumn("letter", letter).join(onward, ["node", "letter"]).filter(F.startswith(F.col("rest"), label))
        frontier = staged(_moved(same, _from(F.col("rest"), F.length(label))), "frontier")
        pairs = pairs.union(frontier.filter(F.col("to").isNotNull()))
    middle = F.floor(F.length("word") / 2).cast("int")
    forward = F.substr("word", F.lit(1), middle) == F.substr("to", F.lit(1), middle)
    found = pairs.filter(((F.col("way") == 0) | ~forward) & (F.levenshtein("word", "to", 1) == 1)).select(
        "word", "n", F.col("to").alias("near"), F.col("to_n").alias("near_n")
    )
    longer = found.filter(F.length("near") > F.length("word"))
    return found.union(longer.select(F.col("near"), F.col("near_n"), F.col("word"), F.col("n")))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, the steps doubled until every root has none."""
    links = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        links = staged(
            links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"
        )


def group_variants(words: DataFrame, *, ratio: int = 5, half: int = 3) -> DataFrame:
    """``word, n, form, form_n, root, n_near`` of distinct words with their counts."""
    words = staged(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = near_words(words, half=half).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.order") >= ratio * F.col("n")
    formed = staged(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.order")).alias("form_n"),
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        ),
        "forms",
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))

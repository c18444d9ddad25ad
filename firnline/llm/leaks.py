"""Evaluation passages inside training documents: Wu-Manber multi-pattern search over words.

Every run of ``min_words`` consecutive words of an item is a pattern.  A block
is three folded words.  The shift table gives for each block that occurs in a
pattern the distance to the nearest pattern end; any other block lets the scan
skip a whole pattern length.  Where the shift is zero, the suffix bucket of the
block lists the item positions that may end here and direct comparison of the
words before them confirms or rejects the occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.cues import skeleton, spoken

BLOCK = 3  # words
BLOCK_CHARS = 8_000_000  # most item text held by one pass over the corpus (tables of about 250 MB)
SENTENCE = r"^\s*([^.?!:\n]+[.?!:])\s"  # a leading sentence
_WORDLIKE = re.compile(rb"[a-z0-9\x7f]")  # letters, digits and the mark of a vanished word


def _placed(said: bytes) -> tuple[list[bytes], list[int], list[bool]]:
    """Folded words of a marked text, the number of the word each came from, and which words vanish when folded."""
    words, place, gone = [], [], []
    for raw in said.split():
        if not _WORDLIKE.search(raw):
            continue
        pieces = skeleton(raw)
        words += pieces
        place += [len(gone)] * len(pieces)
        gone.append(not pieces)
    return words, place, gone


def _vanished(gone: list[bool], at: int, step: int) -> int:
    """How many words in a row vanish from number ``at`` on."""
    n = 0
    while 0 <= at < len(gone) and gone[at]:
        n, at = n + 1, at + step
    return n


class Patterns:
    """Shift table and suffix buckets of a set of items.

    Items are folded as documents are.  A word that folds to nothing (a lone
    accented letter) leaves no trace in the tables, yet counts as a word.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = 12, instructions: tuple[str, ...] = ()):
        self.min_words = min_words
        self.texts: list[tuple[int, list[bytes], list[int], list[bool]]] = []
        heads = sorted(instructions, key=len, reverse=True)
        for item, text in items:
            text = (text or "").lstrip()
            while head := next((h for h in heads if text.startswith(h)), None):
                text = text[len(head) :].lstrip()
            self.texts.append((item, *_placed(spoken(text, True))))
        # shortest pattern in folded words, over all runs of min_words words
        runs = []
        for _, words, place, gone in self.texts:
            upto = [0] * (len(gone) + 1)
            for p in place:
                upto[p + 1] += 1
            for i in range(len(gone)):
                upto[i + 1] += upto[i]
            runs += [upto[i + min_words] - upto[i] for i in range(len(gone) - min_words + 1)]
        self.length = min((n for n in runs if n >= BLOCK), default=0)
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple[int, int]]] = {}
        m = self.length
        if m < BLOCK:
            return
        for t, (_, words, _, gone) in enumerate(self.texts):
            if len(gone) < min_words:
                continue
            for j in range(BLOCK - 1, len(words)):
                block = tuple(words[j - BLOCK + 1 : j + 1])
                # the pattern of m folded words ending nearest at or behind j
                far = max(0, m - 1 - j)
                self.shift[block] = min(self.shift.get(block, m), far)
                if far == 0:
                    self.bucket.setdefault(block, []).append((t, j))

    def search(self, text: str) -> set[int]:
        """Items of which ``min_words`` consecutive words occur in what ``text`` says."""
        found: set[int] = set()
        words = skeleton(spoken(text))
        m, n = self.length, len(words)
        if m < BLOCK or n < m:
            return found
        shift, bucket, texts, skip = self.shift, self.bucket, self.texts, m - BLOCK + 1
        exact: tuple[list[bytes], list[int], list[bool]] | None = None
        i = m - 1
        while i < n:
            block = (words[i - 2], words[i - 1], words[i])
            step = shift.get(block, skip)
            if step:
                i += step
                continue
            for t, j in bucket[block]:
                item, own, place, gone = texts[t]
                if item in found:
                    continue
                a, b = i - BLOCK, j - BLOCK
                while a >= 0 and b >= 0 and words[a] == own[b]:
                    a -= 1
                    b -= 1
                # extend forward too: words that vanish make patterns of unequal length
                c, e = i + 1, j + 1
                while c < n and e < len(own) and words[c] == own[e]:
                    c += 1
                    e += 1
                first, last = place[b + 1], place[e - 1]
                have = last - first + 1
                before, behind = _vanished(gone, first - 1, -1), _vanished(gone, last + 1, 1)
                if have < self.min_words <= have + before + behind:
                    # it hangs on words at the edges that leave no trace: does the document have some there too
                    exact = exact or _placed(spoken(text, True))
                    _, at, lost = exact
                    have += min(before, _vanished(lost, at[a + 1] - 1, -1)) + min(behind, _vanished(lost, at[c - 1] + 1, 1))
                if have >= self.min_words:
                    found.add(item)
            i += 1
        return found


def standing_instructions(items: DataFrame, text: str, *, least: int = 5, share: float = 0.02, rounds: int = 3) -> tuple[str, ...]:
    """Leading sentences shared by at least ``least`` items and ``share`` of all: at most ``rounds / share`` of them.

    What every question of a suite begins with is no passage of the item.
    After a round the sentences found are cut off and the next ones counted.
    """
    rest = items.select(F.col(text).cast("string").alias("t")).where("t is not null")
    n = rest.count()
    found: list[str] = []
    for _ in range(rounds):
        heads = rest.select(F.regexp_extract("t", SENTENCE, 1).alias("h")).where("h <> ''").groupBy("h").agg(F.count("*").alias("k"))
        new = [r.h for r in heads.where(F.col("k") >= max(least, share * n)).collect()]  # at most 1 / share rows
        if not new:
            break
        found += new
        head = F.regexp_extract("t", SENTENCE, 1)
        rest = rest.where(head.isin(new)).select(F.ltrim(F.substr(F.ltrim("t"), F.length(head) + 1)).alias("t"))
    return tuple(found)


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded text, streamed to the driver one partition at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item_id).cast("bigint"), F.col(text).cast("string")).where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    for i, t in rows.toLocalIterator():
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    block_chars: int = BLOCK_CHARS,
    instructions: tuple[str, ...] | None = None,
) -> DataFrame:
    """``(doc_id, item_id)`` of every document that quotes ``min_words`` consecutive words of an item.

    The items are the query set: they are read in blocks of at most
    ``block_chars`` characters and each block is searched in all documents, so
    memory does not grow with either side: one scan of the corpus per block.
    ``instructions`` are sentences before an item's own text; by default those
    that many items begin with.  Whole texts are read, in any script.  A run of
    words of which fewer than three leave a letter is not searched.  Documents
    with null id or text, and items shorter than ``min_words``, give no rows;
    repeated documents count each; an empty side gives an empty result.
    """
    spark = docs.sparkSession
    names = [F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)]
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    out: DataFrame | None = None
    if instructions is None:
        instructions = standing_instructions(items, item_text)
    for block in _blocks(items, item_id, item_text, block_chars):

        sent = spark.sparkContext.broadcast(block)  # bounded by block_chars

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pats = Patterns(sent.value, min_words, instructions)
            for b in batches:
                ids, hits = [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for item in sorted(pats.search(t.as_py())):
                        ids.append(d)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        one = corpus.mapInArrow(run, "doc_id bigint, item_id bigint")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.select(*names)
